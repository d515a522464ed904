"""Exact nearest neighbours, quantised scans with reranking, votes and recall.

Queries and corpus are dealt into blocks; each pair of blocks is one matrix product in one task, and only the best
``k`` of a block pair leave it. So memory is bounded by the block sizes, no row pairs are shuffled, and neither side
is broadcast. Distances are rounded to six digits; equal ones come by id, so results don't depend on the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Queries and corpus rows in a block, and queries whose distances to a block of rows are held at a time.
QUERIES, ROWS, SLICE = 8_192, 16_384, 128
#: The most neighbours a search gives, and rows in a chunk for ties by chunk.
MOST, CHUNK = 4096, 1024


def quantize(x: np.ndarray) -> np.ndarray:
    return np.clip(np.trunc((x + 1.0) / (2.0 / 255.0) - 128.0), -128, 127)


def distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """A row for each query. cosine: 1 - similarity (1 if a side has no length); ip: minus the product."""
    if metric == "int8":
        q, c, metric = quantize(q), quantize(c), "cosine"
    if metric == "f16":
        q, c, metric = q.astype(np.float16).astype(float), c.astype(np.float16).astype(float), "cosine"
    if metric == "l1":
        return np.stack([np.abs(c - x).sum(axis=1) for x in q]) if len(q) else np.zeros((0, len(c)))
    if metric == "hamming":
        a, b = (np.packbits(x > 0, axis=1) for x in (q, c))
        return np.stack([np.bitwise_count(b ^ x).sum(axis=1) for x in a]).astype(float)
    product = q @ c.T
    if metric == "ip":
        return -product
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
        return 1.0 - np.divide(product, size, out=np.zeros_like(product), where=size > 0)
    square = (q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * product
    square = np.maximum(square, 0)
    return square if metric == "l2_squared" else np.sqrt(square)


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("id").to_numpy()
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0)
    if len(ids) and len(flat) % len(ids):
        raise ValueError("vectors have different dimensions")
    return ids, flat.reshape(len(ids), len(flat) // max(1, len(ids)))


FOUND = "query_id bigint, id bigint, distance double"


def tie_order(ids, ties: str):
    """What orders rows at equal distances: the id, or the chunk of the id and in a chunk the last row first."""
    return ids if ties == "id" else ids - 2 * (ids % CHUNK)


def _best(k: int, metric: str, most: float | None, ties: str = "id"):
    """A call on a block of queries and one of rows: the ``k`` nearest rows of each query."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        (qi, q), (ci, c) = _matrix(a), _matrix(b)
        out = [], [], []
        if len(qi) and len(ci) and k:
            if q.shape[1] != c.shape[1]:
                raise ValueError("queries and corpus have different dimensions")
            sliced = (np.round(distances(q[s : s + SLICE], c, metric), 6) for s in range(0, len(qi), SLICE))
            for row, x in zip(qi, (x for d in sliced for x in d), strict=True):
                near = np.flatnonzero(x <= np.partition(x, min(k, len(x)) - 1)[min(k, len(x)) - 1])
                near = near[np.lexsort((tie_order(ci[near], ties), x[near]))][:k]
                near = near[x[near] <= most] if most is not None else near
                out[0].append(np.full(len(near), row))
                out[1].append(ci[near])
                out[2].append(x[near])
        join = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        return pa.table({"query_id": join(out[0], np.int64), "id": join(out[1], np.int64), "distance": join(out[2], np.float64) + 0.0})

    return run


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding", most: float | None = None, ties: str = "id") -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest rows of ``corpus`` for each query, itself included if it is there.

    Equal distances come by id, or with ``ties`` of "chunk" as a store of chunks of CHUNK rows gives them (``tie_order``).

    ``most`` leaves out greater distances. k of 0 gives no rows; a negative one, one above MOST or a wrong dimension is an error.
    Predicates on rows (ranges, lists, ids from another table) are filters and semi joins of ``corpus`` before the call.
    """
    if not 0 <= k <= MOST:
        raise ValueError(f"k must be from 0 to {MOST}")
    n_queries, n_rows = queries.count(), corpus.count()
    query_blocks, row_blocks = -(-n_queries // QUERIES) or 1, -(-n_rows // ROWS) or 1
    plain = lambda df, blocks, name: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias(name))
    left = plain(queries, query_blocks, "qb").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = plain(corpus, row_blocks, "rb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(_best(k, metric, most, ties), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", tie_order(F.col("id"), ties)))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def within(queries: DataFrame, corpus: DataFrame, ids: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", **options) -> DataFrame:
    """``knn`` over the rows whose id is in ``ids``: a semi join before any distance."""
    return knn(queries, corpus.join(ids.select(id_col).distinct(), id_col, "left_semi"), k, metric, id_col=id_col, **options)


#: Rows that an index is fitted on at most, passes over them, and the part of the lists that a search probes. Vectors without clusters, like the given
#: ones, need so many for a recall of 0.95; clustered ones far fewer, so callers measure (``recall``) and choose.
SAMPLE, PASSES, PROBED = 20_000, 8, 0.7


def centres(corpus: DataFrame, lists: int, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """``lists`` unit vectors by spherical k-means over a sample: the ``sample`` rows with the least hash of their id, the only rows that come to the driver."""
    rows = corpus.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(vector).cast("array<double>")).collect()
    if not rows:
        return np.zeros((1, 0))  # one list, of nothing
    x = np.array([r[0] for r in rows], float).reshape(len(rows), -1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(PASSES):
        own = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 0, sums / np.maximum(size, 1e-12), centre)
    return centre


def _nearest_centres(df: DataFrame, centre: np.ndarray, many: int, id_col: str, vector: str) -> DataFrame:
    """(id, v, list): each row with its ``many`` nearest lists; rows without length are in the first list."""
    sent = df.sparkSession.sparkContext.broadcast(centre)  # lists x dimension numbers, set by the caller

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            x = np.array(v.to_pylist(), float).reshape(len(v), -1 if len(v) else sent.value.shape[1])
            if sent.value.shape[1] and x.shape[1] != sent.value.shape[1]:
                raise ValueError("vectors and index have different dimensions")
            score = x @ sent.value.T if sent.value.shape[1] else np.zeros((len(x), 1))
            near = np.argsort(-score, axis=1, kind="stable")[:, :many].astype(np.int32)
            k = near.shape[1]
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), v.take(pa.array(at)), pa.array(near.reshape(-1))], names=["id", "v", "list"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "id bigint, v array<double>, list int")


def build_index(corpus: DataFrame, lists: int, id_col: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> tuple[np.ndarray, DataFrame]:
    """An inverted-file index: centres, and every row (id, v, list) with its nearest one. Only the fit uses a sample."""
    centre = centres(corpus, lists, id_col, vector, sample)
    return centre, _nearest_centres(corpus, centre, 1, id_col, vector)


def search_index(index: tuple[np.ndarray, DataFrame], queries: DataFrame, k: int, probes: int | None = None, metric: str = "cosine", id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): approximate neighbours, exact distances within the ``probes`` lists nearest to a query.

    Queries meet only the rows of their lists, list by list and in blocks of ROWS rows, so the work per query doesn't grow with the whole corpus if lists grow with it."""
    if not 0 <= k <= MOST:
        raise ValueError(f"k must be from 0 to {MOST}")
    centre, rows = index
    probes = probes or max(1, round(len(centre) * PROBED))
    sizes = rows.groupBy("list").agg((F.floor(F.count(F.lit(1)) / ROWS) + 1).alias("blocks"))
    asked = _nearest_centres(queries, centre, probes, id_col, vector).join(sizes, "list")
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select("id", "v", "list", "block")
    right = rows.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("id", "v", "list", "block")
    found = left.groupBy("list", "block").cogroup(right.groupBy("list", "block")).applyInArrow(_best(k, metric, None), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` best of each query's candidates by exact cosine distance."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector).alias("qv"))
    c = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("cv"))
    exact = candidates.select("query_id", "id").join(q, "query_id").join(c, "id").select("query_id", "id", F.round(V.cosine_distance(F.col("qv"), F.col("cv")), 6).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return exact.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def label_vote(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Share in whole percent of each query's neighbours by label."""
    n = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    votes = found.join(labels, "id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.join(n, "query_id").select("query_id", "label", F.floor(F.col("votes") * 100 / F.col("n")).cast("bigint").alias("percent"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the part of all true neighbours that was found."""
    hits = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1)), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


def hit_rates(queries: DataFrame, first: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, hit_rate, of_all) of queries (query_id, has_gold) and the rank of the first gold row of those that have one among what was found.

    hit_rate is over queries with gold, of_all over all of them."""
    hits = queries.join(first, "query_id", "left").select("has_gold", "rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hit = F.coalesce((F.col("rank") <= F.col("k")).cast("int"), F.lit(0))
    return hits.groupBy("k").agg(F.round(F.avg(F.when(F.col("has_gold"), hit)), 6).alias("hit_rate"), F.round(F.avg(hit), 6).alias("of_all"))
