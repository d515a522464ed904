"""Exact dedup by heavy-hitter split, in DataFrame functions only.

A frequent-items sketch (Misra-Gries counters, merged over all partitions) proposes digests that may
be frequent. One exact count verifies them, and the verified winners, at most ``capacity`` rows of
under 100 bytes, are broadcast: all rows of such a digest are decided where they are read and never shuffled.
Other digests go through an ordinary shuffle. The sketch can miss a digest of under 1/1000 of all rows, no more, so no
task gets more of one digest than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import fresh, materialize, read

WINNERS = "digest string, keep_id bigint, winner bigint, group_size bigint"


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as lowercase hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def heavy_hitters(keys: DataFrame, capacity: int, tracked: int, least: int) -> DataFrame:
    """Verified frequent digests of (row, doc_id, digest): (digest, keep_id, winner, group_size), at most ``capacity`` rows.

    The sketch's error only decides which digests are proposed. Counts and winners are exact.
    """
    spark = keys.sparkSession
    proposed = keys.agg(F.expr(f"approx_top_k(digest, {capacity}, {tracked})").alias("top")).select(F.explode("top").alias("t"))
    names = [r[0] for r in proposed.select("t.item").collect()]  # at most `capacity` digests
    if not names:
        return spark.createDataFrame([], WINNERS)
    listed = spark.createDataFrame([(x,) for x in names], "digest string")
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("row")).alias("before")))
    exact = keys.join(F.broadcast(listed), "digest").groupBy("digest").agg(last.alias("last"), F.count(F.lit(1)).alias("group_size"))
    rows = exact.filter(F.col("group_size") >= least).select("digest", "last.doc_id", -F.col("last.before"), "group_size").collect()  # at most `capacity` rows
    return spark.createDataFrame([tuple(r) for r in rows], WINNERS)


def _decided(docs: DataFrame, id_col: str, text_col: str, capacity: int, tracked: int, least: int) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256); ``row`` is the row's place in the scan."""
    keys = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), digest(F.col(text_col)).alias("digest")), "exact-keys")
    marked = keys.join(F.broadcast(heavy_hitters(keys, capacity, tracked, least)), "digest", "left")
    heavy, rest = marked.filter(F.col("winner").isNotNull()), marked.filter(F.col("winner").isNull())
    group = Window.partitionBy("digest")
    rest = rest.withColumns({
        "rank": F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last(), "row")),
        "keep_id": F.max("doc_id").over(group),
        "group_size": F.count(F.lit(1)).over(group),
    })
    columns = lambda kept: ["row", "doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256")]
    return heavy.select(*columns(F.col("row") == F.col("winner"))).unionByName(rest.select(*columns(F.col("rank") == 1)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tracked: int = 8192, least: int = 24) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as the empty text. Of equal texts the row
    with the largest id stays (null ids come last). Rows that repeat both id and text are copies too:
    exactly one of them is kept. An empty table gives no rows; other columns are ignored.
    """
    return _decided(docs, id_col, text_col, capacity, tracked, least).drop("row")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tracked: int = 8192, least: int = 24, stored: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of equal texts (null counts as empty) the row with the largest
    id, null ids last, and one of rows that repeat both. An empty table stays empty.

    Rows are told apart by their place in the scan, so no text or id is a hot key of the join. ``docs`` is written to the
    shared folder first unless it is ``stored``, a plain read of a table."""
    docs = docs if stored else materialize(docs, "exact-docs")
    here, lost = fresh(docs, "row", "lost")
    gone = materialize(_decided(docs, id_col, text_col, capacity, tracked, least).filter(~F.col("kept")).select(F.col("row").alias(lost)), "exact-lost")
    placed = docs.withColumn(here, F.monotonically_increasing_id())
    return placed.join(gone, F.col(here) == F.col(lost), "left_anti").drop(here)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
