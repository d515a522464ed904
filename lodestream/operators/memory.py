"""Agent memory: which turns and records a context holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .knn import knn

def last_turns(turns: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n).drop("age")


def within(turns: DataFrame, span: int) -> DataFrame:
    """Turns less than ``span`` older than the conversation's newest."""
    newest = F.max("turn").over(Window.partitionBy("conv_id"))
    return turns.withColumn("newest", newest).filter(F.col("turn") > F.col("newest") - span).drop("newest")


def within_time(turns: DataFrame, seconds: int, at: str = "ts") -> DataFrame:
    """Turns at most ``seconds`` older than the conversation's newest, by their time."""
    newest = F.max(at).over(Window.partitionBy("conv_id"))
    return turns.withColumn("newest", newest).filter(F.col(at) >= F.col("newest") - F.expr(f"INTERVAL {int(seconds)} SECOND")).drop("newest")


def custom(turns: DataFrame, keep) -> DataFrame:
    """A caller's own rule: ``keep`` makes a condition from (age, 0 for the newest turn; length of the text; characters of all newer turns)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    size = F.coalesce(F.length("text"), F.lit(0))
    newer = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    aged = turns.withColumns({"_age": F.row_number().over(w) - 1, "_newer": newer})
    return aged.filter(keep(F.col("_age"), size, F.col("_newer"))).drop("_age", "_newer")


def recalled(vectors: DataFrame, k: int, recent: int) -> DataFrame:
    """VectorRecall over (conv_id, turn, v): the ``recent`` newest turns, and the ``k`` others whose vectors are nearest to the newest one's by cosine.

    The newest vector of each conversation is joined to its turns; no pairs of turns are made."""
    last = vectors.groupBy("conv_id").agg(F.max_by("v", "turn").alias("_q"))
    w = Window.partitionBy("conv_id")
    aged = vectors.withColumn("_age", F.row_number().over(w.orderBy(F.desc("turn"))))
    near = aged.filter(F.col("_age") > recent).join(last, "conv_id").withColumn("_d", F.round(F.coalesce(V.cosine_distance(F.col("v"), F.col("_q")), F.lit(1.0)), 6))
    similar = near.withColumn("_r", F.row_number().over(w.orderBy("_d", "turn"))).filter(F.col("_r") <= k).select("conv_id", "turn")
    return recall_turns(aged.filter(F.col("_age") <= recent).select("conv_id", "turn"), similar, ["conv_id", "turn"])


class ContextStore:
    """Records (id, ts, tags array<string>, text, v array<float>) as versions of a log (seq, deleted): put, get, delete, count, iterate, flush, search.

    Every call gives a new store over a longer log; state is the last version of each id after the last flush."""

    def __init__(self, log: DataFrame):
        self.log = log

    def put(self, records: DataFrame) -> ContextStore:
        return ContextStore(self.log.unionByName(records.withColumn("deleted", F.lit(False))))

    def delete(self, ids: DataFrame) -> ContextStore:
        """``ids``: (seq, id)."""
        gone = ids.select("seq", "id", F.lit(True).alias("deleted"))
        return ContextStore(self.log.unionByName(gone, allowMissingColumns=True))

    def flush(self, seq: int) -> ContextStore:
        """Everything up to ``seq`` goes."""
        return ContextStore(self.log.filter(F.col("seq") > seq))

    def records(self) -> DataFrame:
        columns = [c for c in self.log.columns if c != "id"]
        last = self.log.groupBy("id").agg(F.max_by(F.struct(*columns), "seq").alias("r"))
        return last.filter(~F.col("r.deleted")).select("id", "r.*").drop("deleted")

    def get(self, ids: DataFrame) -> DataFrame:
        """Records in the order of the ids asked, null where there is none."""
        return ids.join(self.records(), "id", "left")

    def count(self) -> DataFrame:
        return self.records().agg(F.count(F.lit(1)).alias("n"))

    def pages(self, size: int) -> DataFrame:
        """All records with the page that an iteration by id has them on: numbered within ranges of ids, with the count before each range."""
        return numbered(self.records(), "id").withColumn("page", F.floor(F.col("number") / size))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, id, distance) by cosine; a search by text alone has no vector and finds nothing."""
        return knn(queries, self.records(), k, id_col="id", vector="v")


def numbered(rows: DataFrame, order: str, by: tuple[str, ...] = (), width: int = 1 << 16) -> DataFrame:
    """Adds number, from 0 in the order of an id within ``by``: rows are numbered within ranges of ``width`` ids, and the counts of the ranges before
    are added, so no task gets all rows of a group."""
    cell = F.floor(F.col(order) / width)
    own = rows.withColumn("_cell", cell)
    counts = own.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(order)) - 1
    return own.withColumn("_place", place).join(counts, [*by, "_cell"]).withColumn("number", F.col("_place") + F.col("_before")).drop("_cell", "_place", "_before")


def rolling_summary(turns: DataFrame, keep: int) -> DataFrame:
    """Older turns as one row of counts, in place of their texts; how many are kept."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    aged = turns.withColumn("old", F.row_number().over(w) > keep)
    return aged.groupBy("conv_id").agg(
        F.sum(F.col("old").cast("bigint")).alias("summarised"),
        F.sum((~F.col("old")).cast("bigint")).alias("kept"),
        F.coalesce(F.sum(F.when(F.col("old"), F.length("text"))), F.lit(0)).cast("bigint").alias("chars"),
    )


def recall_turns(recent: DataFrame, similar: DataFrame, key: list[str]) -> DataFrame:
    """Similar turns that aren't recent, and the recent ones: each once."""
    return similar.join(recent, key, "left_anti").unionByName(recent).dropDuplicates(key)


def by_range(records: DataFrame, column: str, start, end, limit: int = 1000) -> DataFrame:
    """A range query's first ``limit`` records by time, as one page."""
    return records.filter(F.col(column).between(start, end)).orderBy(column, "id").limit(limit)
