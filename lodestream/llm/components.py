"""Connected components in Spark: alternating large and small stars, with checkpoints between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut


def _star(directed: DataFrame) -> DataFrame:
    """directed: (u, v). Adds the least of u and its v's as m. The minimum is pre-aggregated; hubs are joined back, where skew can be split."""
    least = directed.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return directed.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component. No edges give no rows."""
    now = cut(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u != v").distinct())
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large.filter("u != v").distinct())
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError("components did not settle")
