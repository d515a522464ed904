"""Quality classifier: Naive Bayes support vectors.

A document's features are indicators of its hashed byte n-grams, seen at all and seen often. Each is scaled by the
log ratio of its class counts, rows are brought to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent. The fit uses a bounded sample: the ``fit_rows`` labelled training documents with the least hash
of their id, as many of them as have ``fit_features`` features together, so the ids can be broadcast and the driver's share is bounded. Scoring reads every text.
"""

from __future__ import annotations

from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality_rules import BITS, _blocks, _raw, buckets
from .util import materialize, read, slices

#: Labelled documents that a fit uses at most, and features of all of them (4 bytes each come to the driver); passes over them; the hinge loss's weight against the norm; an n-gram is frequent from so many uses.
FIT_ROWS, FIT_FEATURES, PASSES, COST, OFTEN = 6_000, 48_000_000, 12, 4.0, 6
#: Features: n-grams that occur, n-grams that occur often, and runs of two, three and four equal words.
RUNS = 2 << BITS
SIZE = RUNS + 3


def word_runs(raw: bytes) -> list[int]:
    """The features of n-grams of one repeated word, for n of 2 to 4."""
    words, out = raw.split(), []
    same = list(map(eq, words, words[1:]))
    for k in range(3):
        if not any(same):
            break
        out.append(RUNS + k)
        same = list(map(and_, same, same[1:]))
    return out


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Ascending feature numbers of each text."""
    out = []
    for a, b in _blocks(texts):
        hashed, starts = buckets(texts[a:b])
        edges = [*starts.tolist(), len(hashed)]
        for raw, s, e in zip(texts[a:b], edges, edges[1:], strict=False):
            seen, uses = np.unique(hashed[s:e], return_counts=True)
            often = seen[uses >= OFTEN]
            out.append(np.concatenate((seen.astype(np.int32), often.astype(np.int32) + (1 << BITS), np.array(word_runs(raw), np.int32))))
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, passes: int = PASSES, cost: float = COST) -> tuple[np.ndarray, float]:
    """(weights, bias) so that the margin of a row is sum(weights[row]) / norm + bias, norm as in ``margins``."""
    ratios = log_ratios(rows, labels)
    sign = np.where(labels == 1, 1.0, -1.0)
    if len(rows) == 0 or abs(sign.sum()) == len(rows):  # one class or none: the prior
        return np.zeros(SIZE), float(np.sign(sign.sum()))
    scaled = [ratios[r] / (np.linalg.norm(ratios[r]) or 1.0) for r in rows]
    square = np.array([float(x @ x) for x in scaled]) + 1.0
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(SIZE), 0.0
    rng = np.random.default_rng(0)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            grams, x, y = rows[i], scaled[i], sign[i]
            gradient = y * (weights[grams] @ x + bias) - 1.0
            step = min(max(alpha[i] - gradient / square[i], 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                weights[grams] += step * y * x
                bias += step * y
    return weights, bias


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of (count in class 1, by class) to (count in class 0, by class), add-one smoothed."""
    counts = np.ones((2, SIZE))
    for grams, y in zip(rows, labels, strict=True):
        counts[int(y), grams] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_features: int) -> list[tuple[int, int, bytes]]:
    """(doc_id, label, features) of the documents that the fit uses. Of several labels for an id the largest counts, of several texts the last in byte order."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def run(batches):
        for batch in slices(batches):
            grams = [x.tobytes() for x in features(_raw(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.binary())], names=["doc_id", "y", "grams"])

    chosen = docs.join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select("doc_id", "y", "text")
    once = chosen.mapInArrow(run, "doc_id bigint, y int, grams binary").groupBy("doc_id", "y").agg(F.max("grams").alias("grams"))
    stored = materialize(once, "fit-rows")  # at most fit_rows documents
    room = F.sum(F.octet_length("grams") / 4).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    named = stored.withColumn("room", room).filter(F.col("room") <= fit_features).select("doc_id")
    return sorted(tuple(r) for r in stored.join(F.broadcast(named), "doc_id").select("doc_id", "y", "grams").collect())


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """(ratios, weights, bias) from labelled documents that aren't held out."""
    found = sampled(docs, labels, fit_rows, fit_features)
    rows, y = [np.frombuffer(g, np.int32) for _, _, g in found], np.array([y for _, y, _ in found], np.int64)
    weights, bias = fit(rows, y)
    return log_ratios(rows, y), weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document's whole text."""
    ratios, weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((ratios.astype(np.float32) ** 2, (ratios * weights).astype(np.float32), bias))

    def run(batches):
        squares, products, bias = sent.value
        for batch in slices(batches):
            margins = [products[g].sum(dtype=np.float64) / (np.sqrt(squares[g].sum(dtype=np.float64)) or 1.0) + bias for g in features(_raw(batch.column(1)))]
            p = np.round(1 / (1 + np.exp(-np.clip(np.array(margins, np.float64), -30, 30))), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Scores from 0 to 1; predicted is 1 from 0.5 on.

    Null and empty texts have no features and get the constant's score; without labels of both classes every row gets
    the prior's. Repeated rows score alike and count once in the fit, null ids aren't held out, an empty table gives no rows, other columns are ignored.
    """
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return score(plain, train(plain, labels, fit_rows))


def op2_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
