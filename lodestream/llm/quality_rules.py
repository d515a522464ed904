"""Quality rules: plain text statistics, and a hashed n-gram log-likelihood ratio of trusted text to the raw corpus.

Two multinomials over hashed byte n-grams are estimated: one from trusted documents, one from every
document. A document's score is the mean log ratio of its n-grams, so long and short documents compare. A
document is kept if it passes the base rules and its score is at least the threshold; nothing is drawn at random.

Counting and scoring read the corpus a batch at a time. Only the ``2**BITS`` counts come to the driver, whatever the
input. All documents labelled good are trusted: a join with their ids finds their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import materialize, read, slices

#: Bytes in an n-gram; bits of its hash.
GRAM, BITS = 4, 16
#: The least mean log ratio (natural logarithm) of a kept document.
THRESHOLD = -0.25
SYMBOLS = b"#*$%&|<>"
#: Bytes of text that are hashed at a time, or one document.
BLOCK = 1 << 20


def base_counts(raw: bytes) -> tuple[int, int, int, int]:
    """n_words, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text. Words are what space and bytes 9 to 13 separate."""
    words = raw.split()
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else ()
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        at: dict[tuple, int] = {}
        marked = bytearray(len(words))
        for i, w in enumerate(windows):
            first = at.setdefault(w, i)
            if first != i:
                marked[first : first + 3] = marked[i : i + 3] = b"\1\1\1"
        repeated = sum(marked)
    return len(words), symbols, len(lines) - len(set(lines)), repeated


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of the texts, and where each text's begin. A text shorter than an n-gram has none."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    n = len(joined) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
    code = joined[:n].astype(np.uint32)
    for k in range(1, GRAM):
        code |= joined[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    hashed = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)
    inside = np.ones(n, bool)
    for k in range(1, GRAM):  # n-grams across the border of two texts
        cut = ends[:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    starts = np.concatenate(([0], ends[:-1]))
    kept = np.concatenate(([0], np.cumsum(inside)))
    return hashed[inside], kept[np.minimum(starts, n)]


def _blocks(texts: list[bytes]):
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def gram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, target, corpus): counts of each hashed n-gram in the trusted documents and in all; each task sums its own first.

    ``docs`` is a stored table (doc_id, text). Trusted documents come by a join, which no null id passes; a task holds a batch of texts at a time.
    """

    def count(batches):
        counts = np.zeros(1 << BITS, np.int64)
        for batch in slices(batches):
            texts = _raw(batch.column(0))
            for a, b in _blocks(texts):
                counts += np.bincount(buckets(texts[a:b])[0], minlength=1 << BITS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["bucket", "n"])

    def counted(some: DataFrame) -> DataFrame:
        return some.select("text").mapInArrow(count, "bucket int, n bigint")

    good = docs.join(trusted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")  # the same at every size
    none = F.lit(0).cast("bigint")
    rows = counted(good).select("bucket", F.col("n").alias("target"), none.alias("corpus")).unionByName(counted(docs).select("bucket", none.alias("target"), F.col("n").alias("corpus")))
    return rows.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("corpus").alias("corpus"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log of target share to corpus share for each bucket, add-one smoothed; all zero without trusted text."""
    both = np.zeros((2, 1 << BITS))
    for bucket, target, corpus in counts.collect():  # at most 2**BITS rows
        both[:, bucket] = target, corpus
    if not both[0].any():
        return np.zeros(1 << BITS)
    smooth = both + 1
    return np.diff(np.log(smooth / smooth.sum(axis=1, keepdims=True)), axis=0)[0] * -1


def verdicts(texts: list[bytes], column: pa.Array, w: np.ndarray, threshold: float) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept of a batch."""
    base = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 4)
    spaces = np.array([sum(map(t.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))) for t in texts], np.int64)
    chars = np.asarray(pc.utf8_length(pc.fill_null(column, "")), np.int64)
    means = []
    for a, b in _blocks(texts):
        hashed, starts = buckets(texts[a:b])
        sums = np.concatenate(([0.0], np.cumsum(w[hashed])))
        ends = np.concatenate((starts[1:], [len(hashed)]))
        means.append((sums[ends] - sums[starts]) / np.maximum(1, ends - starts))
    llr = np.round(np.concatenate(means), 9) if means else np.zeros(0)
    failed = (base[:, 0] < 50) | (100 * base[:, 3] > 50 * base[:, 0])
    return [base[:, 0], chars - spaces, base[:, 1], base[:, 2], base[:, 3], failed, llr, ~failed & (llr >= threshold)]


def score(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, llr, kept."""
    weights = docs.sparkSession.sparkContext.broadcast(ratios)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]

    def run(batches):
        for batch in slices(batches):
            found = verdicts(_raw(batch.column(1)), batch.column(1), weights.value, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names=names)

    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, llr double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def model(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratios from (doc_id, text) and the trusted ones among the labelled documents."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return log_ratios(gram_counts(docs, good))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, stored: bool = False) -> DataFrame:
    """Base counts, score and verdict of every document.

    Trusted are the documents that ``labels`` gives quality 1. Null texts count as empty and fail the base rules;
    repeated rows are judged alike, rows with a null id are never trusted; without trusted documents every score is 0;
    an empty table gives no rows; other columns are ignored. ``docs`` is written to the shared folder first unless it is ``stored``, a plain read of a table.
    """
    plain = _plain(docs, id_col, text_col)
    plain = plain if stored else materialize(plain, "quality-docs")
    return score(plain, model(plain, labels), threshold)


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, stored: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns unchanged.

    Null and empty texts go, as they fail the base rules; repeated rows stay or go together; null ids are judged like
    others; an empty table gives no rows."""
    docs = docs if stored else materialize(docs, "quality-docs")
    weights = docs.sparkSession.sparkContext.broadcast(model(_plain(docs, id_col, text_col), labels))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(verdicts(_raw(batch.column(at)), batch.column(at), weights.value, threshold)[-1]))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), stored=True)
