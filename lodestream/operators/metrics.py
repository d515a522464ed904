"""Evaluation: thresholds, ROC, calibration, percentiles, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.round(a / F.nullif(b, F.lit(0)), 6))


def threshold_sweep(p: DataFrame, steps: int = 20) -> DataFrame:
    """Confusion counts and rates of probability >= threshold, for thresholds 0/steps..steps/steps.

    Scores are first counted per step they reach, so the input is shuffled as at most steps + 1 rows a task, and the
    counts at or above each threshold are running sums over those."""
    reached = F.least(F.floor(F.round(F.col("probability") * steps, 6)), F.lit(steps)).cast("int")
    counted = p.groupBy(reached.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("truth").cast("bigint")).alias("pos"))
    spark = p.sparkSession
    grid = spark.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    full = grid.join(counted, "step", "left").fillna(0)
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    out = full.select(
        "step",
        F.sum("pos").over(above).alias("tp"),
        F.sum(F.col("n") - F.col("pos")).over(above).alias("fp"),
        F.sum("pos").over(every).alias("p"),
        F.sum(F.col("n") - F.col("pos")).over(every).alias("q"),
    )
    return out.select(
        F.round(F.col("step") / steps, 6).alias("threshold"),
        "tp",
        "fp",
        (F.col("p") - F.col("tp")).alias("fn"),
        (F.col("q") - F.col("fp")).alias("tn"),
        _rate(F.col("tp"), F.col("p")).alias("recall"),
        _rate(F.col("fp"), F.col("q")).alias("fpr"),
        _rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def auc(points: DataFrame) -> DataFrame:
    """Trapezoids under (fpr, recall), with (0, 0) and (1, 1) added."""
    spark = points.sparkSession
    ends = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, recall double")
    w = Window.orderBy("fpr", "recall")
    steps = points.select("fpr", "recall").unionByName(ends).select("fpr", "recall", F.lag("fpr").over(w).alias("x0"), F.lag("recall").over(w).alias("y0"))
    return steps.agg(F.round(F.sum((F.col("fpr") - F.col("x0")) * (F.col("recall") + F.col("y0")) / 2), 6).alias("auc"))


#: Words that name fault patterns in a report.
PATTERNS = ("spike", "drift", "dropout", "oscillation", "precursor")


def report_score(text: Column, anomalies: Column, highest: Column) -> Column:
    """What a written report gets right, as struct<count_ok, max_ok, min_ok, patterns, consistency>: its total_faults within 3, its max_temp within
    2 degrees, a min_temp below 5, and how many pattern words it has. A number that isn't there is wrong."""
    number = lambda name: F.nullif(F.regexp_extract(text, f'"{name}"\\s*:\\s*"?(-?[0-9]+(?:\\.[0-9]+)?)', 1), F.lit("")).cast("double")
    right = lambda c: F.coalesce(c, F.lit(False))
    count, top, low = right(F.abs(number("total_faults") - anomalies) <= 3), right(F.round(F.abs(number("max_temp") - highest), 6) <= 2.0), right(number("min_temp") < 5.0)
    patterns = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in PATTERNS[1:]), F.contains(F.lower(text), F.lit(PATTERNS[0])).cast("int"))
    return F.struct(count.alias("count_ok"), top.alias("max_ok"), low.alias("min_ok"), patterns.alias("patterns"), (count.cast("int") + top.cast("int") + low.cast("int")).alias("consistency"))


def percentile_low(values: Column, p: float) -> Column:
    """sorted[min(floor(n p), n - 1)]"""
    v = F.array_sort(values)
    return F.element_at(v, F.least(F.floor(F.size(v) * p), F.size(v) - 1).cast("int") + 1)


def percentile_index(values: Column, p: float) -> Column:
    """sorted[floor(p (n - 1))]"""
    v = F.array_sort(values)
    return F.element_at(v, F.floor((F.size(v) - 1) * p).cast("int") + 1)


def ranked_percentiles(rows: DataFrame, key: str, value: str, ps: tuple[float, ...], low: bool = True) -> DataFrame:
    """(key, p, value) by rank, without collecting a group: counts per distinct value, then running sums over those."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key)
    at = counted.withColumns({"upto": F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    at = at.withColumn("p", F.explode(F.array(*map(F.lit, ps))))
    index = F.least(F.floor(F.col("n") * F.col("p")), F.col("n") - 1) if low else F.floor((F.col("n") - 1) * F.col("p"))
    return at.filter((index < F.col("upto")) & (index >= F.col("upto") - F.col("c"))).select(key, "p", value)


def _poisson_steps(most: int = 8) -> list[tuple[int, float]]:
    """(k, least u) at which a Poisson(1) draw becomes k."""
    out, total, share = [], 0.0, 0.36787944117144233
    for k in range(1, most + 1):
        total += share
        out.append((k, total))
        share /= k
    return out


def row_hash(row: Column | str) -> Column:
    """32 bits of a row's id as text, once a row; draws mix them with their number."""
    text = (F.col(row) if isinstance(row, str) else row).cast("string")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def drawn(rows: DataFrame, rounds: int, first: int = 0) -> DataFrame:
    """Each row (row_id) once for every round from ``first`` on, with ``w``, how often a draw with replacement takes it; rounds below 0 take each row once.

    Poisson(1) weights from the row's hash mixed with the round in whole-number steps that SQL can follow. Each step is a column of its own, so it is
    computed once."""
    out = rows.withColumn("_x", row_hash("row_id")).withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(rounds - 1))))
    out = out.withColumn("_x", F.pmod(F.col("_x") + F.col("round") * 2654435769, F.lit(4294967296)))
    for _ in range(2):
        out = out.withColumn("_x", (F.col("_x").bitwiseXOR(F.shiftright("_x", 16)) * 73244475) % 4294967296)
    out = out.withColumn("_x", F.col("_x").bitwiseXOR(F.shiftright("_x", 16)) / 4294967296.0)
    weight = F.when(F.col("round") < 0, 1)
    for k, least in reversed(_poisson_steps()):
        weight = weight.when(F.col("_x") >= least, k)
    return out.withColumn("w", weight.otherwise(0)).drop("_x")


def poisson_sql(u: str) -> str:
    """The same as a SQL expression of ``u``."""
    return "CASE " + " ".join(f"WHEN {u} >= {least!r}::DOUBLE THEN {k}" for k, least in reversed(_poisson_steps())) + " ELSE 0 END"


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row_id, a, b) from two results (qid, value) of the same questions. A question that only one of them has, or has twice, is an error when the row is read."""
    one, two = (x.groupBy("qid").agg(F.max("value").alias(name), F.count(F.lit(1)).alias(f"n_{name}")) for x, name in ((a, "a"), (b, "b")))
    both = one.join(two, "qid", "full_outer")
    ok = (F.coalesce("n_a", F.lit(0)) == 1) & (F.coalesce("n_b", F.lit(0)) == 1)
    known = F.when(ok, F.col("qid")).otherwise(F.raise_error(F.concat(F.lit("results differ in question "), F.col("qid"))))
    return both.select(known.cast("string").alias("row_id"), "a", "b")


def bootstrap_mean(values: DataFrame, key: str, value: str, rounds: int = 200, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of resampled means per key.

    Poisson(1) weights from a hash of (row, round) stand for drawing with replacement: one pass, no index join, the same
    result on every run. Null and NaN values are dropped."""
    rows = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key, "row_id", F.col(value).cast("double").alias("x"))
    means = drawn(rows, rounds).groupBy(key, "round").agg((F.sum(F.col("x") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    side = (1 - level) / 2
    ends = means.groupBy(key).agg(F.percentile("m", F.lit(side)).alias("low"), F.percentile("m", F.lit(1 - side)).alias("high"))
    return rows.groupBy(key).agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n")).join(ends, key)


def bootstrap_ratio(pairs: DataFrame, rounds: int = 200, level: float = 0.95) -> DataFrame:
    """Ratio of means of paired (row_id, a, b) with a percentile interval and whether it has 1 inside; pairs with b = 0 are dropped."""
    rows = pairs.filter("b != 0 and a is not null")
    ratios = drawn(rows, rounds).groupBy("round").agg((F.sum(F.col("a") * F.col("w")) / F.nullif(F.sum(F.col("b") * F.col("w")), F.lit(0.0))).alias("r"))
    side = (1 - level) / 2
    ends = ratios.agg(F.percentile("r", F.lit(side)).alias("low"), F.percentile("r", F.lit(1 - side)).alias("high"))
    point = rows.agg((F.sum("a") / F.sum("b")).alias("ratio"), F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    return point.join(ends.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("has_one", (F.col("low") <= 1) & (F.col("high") >= 1))


def bootstrap_median_ratio(pairs: DataFrame, rounds: int = 200, level: float = 0.95) -> DataFrame:
    """Ratio of medians of paired (row_id, a, b) with a percentile interval and whether it crosses 1; draws whose lower median isn't positive are dropped."""
    both = drawn(pairs, rounds).withColumn("w", F.col("w").cast("bigint")).filter("w > 0").groupBy("round").agg(F.percentile("a", F.lit(0.5), F.col("w")).alias("a"), F.percentile("b", F.lit(0.5), F.col("w")).alias("b"))
    ratios = both.filter("b > 0").select((F.col("a") / F.col("b")).alias("r"))
    side = (1 - level) / 2
    ends = ratios.agg(F.percentile("r", F.lit(side)).alias("low"), F.percentile("r", F.lit(1 - side)).alias("high")).withColumn("_k", F.lit(1))
    point = pairs.agg((F.percentile("a", F.lit(0.5)) / F.greatest(F.percentile("b", F.lit(0.5)), F.lit(1e-9))).alias("ratio"), F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    return point.join(ends, "_k").drop("_k").withColumn("has_one", (F.col("low") < 1) & (F.col("high") > 1))


def bootstrap_quantile(values: DataFrame, key: str, value: str, p: float, rounds: int = 100, level: float = 0.95) -> DataFrame:
    """A quantile and its percentile interval: per draw the least value at which the drawn rows reach share ``p``.

    Weights are summed per distinct value before they are ordered, so no group is collected."""
    rows = values.filter(F.col(value).isNotNull()).select(key, "row_id", F.col(value).alias("x"))
    summed = drawn(rows, rounds, -1).groupBy(key, "round", "x").agg(F.sum("w").alias("w")).filter("w > 0")
    w = Window.partitionBy(key, "round")
    upto = summed.withColumns({"upto": F.sum("w").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("w").over(w)})
    q = upto.filter(F.col("upto") >= F.col("n") * p).groupBy(key, "round").agg(F.min("x").alias("q"))
    side = (1 - level) / 2
    draws = F.when(F.col("round") >= 0, F.col("q"))
    return q.groupBy(key).agg(F.max(F.when(F.col("round") < 0, F.col("q"))).alias("value"), F.percentile(draws, F.lit(side)).alias("low"), F.percentile(draws, F.lit(1 - side)).alias("high"))
