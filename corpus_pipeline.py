"""The corpus pipeline: quality rules, exact dedup, near-dedup, repeated passages, packing.

Each stage takes all that its predecessor kept, as written Parquet, and all but the last return the columns of
``documents``. The last gives one row per packed piece. Empty tables give empty tables; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, exact_dedup, packing, quality_rules, simhash, suffix_dedup
from lodestream.llm.util import materialize, read, small_batches


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or look unlike trusted text go, null and empty texts among them; equal texts are judged alike."""
    return quality_rules.drop_poor(docs, read(spark, sf_dir, "labels"), stored=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, null counting as empty and null ids last; one of rows that are equal in both."""
    return exact_dedup.drop_copies(docs, stored=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: covering LSH over SimHash proposes, and a pair
    counts if its sets of five-word shingles have a Jaccard similarity of at least 0.8. Rows without an id stay."""
    small_batches(spark)
    return simhash.drop_near(docs, percent=80, shingle=5, stored=True)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that an earlier document has are cut out; n_chars follows. Every row stays, null texts become empty."""
    return suffix_dedup.drop_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens; an empty text is one piece, and rows that repeat have places of their own."""
    small_batches(spark)
    return packing.pack(docs, bpe.default_tokenizer())


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("simhash", near), ("suffix_dedup", passages), ("packing", pack)]

#: SQL can't express hashed likelihood ratios, components of near copies or BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
