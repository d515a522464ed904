"""Temporal fault scores: interpretable signals, a score without memory, and a gate that learns per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signals in order, statuses, signals that trigger a prediction, and the gate's prior and limits.
SIGNALS = (
    "interval_expected",
    "overdue",
    "cluster_dense",
    "cluster_moderate",
    "precursor_strong",
    "rising_near_threshold",
    "dropping_near_threshold",
    "status_flicker",
    "status_out_of_range",
    "status_fault_reported",
)
STATUSES = ("OK", "NO_DATA", "OUT_OF_RANGE", "FAULT", "CALIB_ERROR")
TRIGGERS = ("interval_expected", "overdue", "precursor_strong", "rising_near_threshold", "dropping_near_threshold", "status_flicker", "status_out_of_range")
PRIOR_HITS, PRIOR_MISSES, WARM_UP, LEAST = 2.0, 3.0, 2, 0.30


def parse_status(raw: Column) -> Column:
    """A status by its exact name; anything else, null too, is OK."""
    return F.when(raw.isin(*STATUSES), raw).otherwise("OK")


def features(r: DataFrame, cp: DataFrame) -> DataFrame:
    """Per checkpoint (sensor, cp): what the score needs, from the faults and statuses up to its last reading.

    Fault history and status counts are running aggregates over the readings, so the checkpoint's own
    last row has them; nothing is joined.
    """
    seq = Window.partitionBy("sensor").orderBy("seq")
    so_far = seq.rowsBetween(Window.unboundedPreceding, 0)
    ring = seq.rowsBetween(-14, 0)
    hour = Window.partitionBy("sensor").orderBy("minute").rangeBetween(-60, 0)
    fault = F.col("status") == "FAULT"
    when = F.when(fault, F.col("minute"))
    ring_rows = F.collect_list(F.struct("minute", "status")).over(ring)
    told = r.select(
        "sensor",
        "seq",
        "minute",
        F.sum(fault.cast("int")).over(so_far).alias("faults"),
        F.min(when).over(so_far).alias("first_fault"),
        F.max(when).over(so_far).alias("last_fault"),
        F.sum(fault.cast("int")).over(hour).alias("recent"),
        ring_rows.alias("ring"),
    )
    counted = lambda *s: F.size(F.filter("ring", lambda x: (F.col("minute") - x["minute"] <= 15) & x["status"].isin(*s)))
    ends = told.filter(F.col("seq") % 20 == 0).select(
        "sensor",
        F.floor((F.col("seq") - 1) / 20).alias("cp"),
        "faults",
        "first_fault",
        "last_fault",
        "recent",
        counted("NO_DATA").alias("no_data"),
        counted("OUT_OF_RANGE").alias("out_of_range"),
        counted("FAULT", "CALIB_ERROR").alias("reported"),
    )
    out = cp.join(ends, ["sensor", "cp"])
    interval = F.when(F.col("faults") >= 2, (F.col("last_fault") - F.col("first_fault")) / (F.col("faults") - 1))
    ratio = F.when(interval > 0, (F.col("minute") - F.col("last_fault")) / F.nullif(interval, F.lit(0.0))).otherwise(0.0)
    seen = F.floor((F.col("minute") + 1) / 20)
    base = F.when(seen >= 3, F.col("faults") / F.greatest(seen, F.lit(1))).otherwise(0.30)
    return out.withColumns({"interval_ratio": F.round(F.coalesce(ratio, F.lit(0.0)), 6), "base_rate": F.round(base, 6)})


def signals(precursor_pct: Column) -> dict[str, Column]:
    c, v = F.col, F.col("velocity")
    expected = c("interval_ratio").between(0.8, 1.4)
    return {
        "interval_expected": expected,
        "overdue": ~expected & (c("interval_ratio") > 1.5),
        "cluster_dense": c("recent") >= 3,
        "cluster_moderate": c("recent") == 2,
        "precursor_strong": precursor_pct >= 67,
        "rising_near_threshold": (v > 1.5) & (c("max_t10") > 250),
        "dropping_near_threshold": (v < -1.5) & (c("min_t10") < 100),
        "status_flicker": c("no_data") >= 2,
        "status_out_of_range": c("out_of_range") >= 2,
        "status_fault_reported": c("reported") >= 1,
    }


def score(f: DataFrame, precursor_pct: Column, statuses: bool = True) -> DataFrame:
    """(sensor, cp, probability, predicted, fired, has_anomaly): the score without the learned gate. Without ``statuses`` the older
    engine's, which knows no status signals."""
    pct = precursor_pct
    s = {k: c for k, c in signals(pct).items() if statuses or not k.startswith("status_")}
    plus = lambda k, x: F.when(s[k], x).otherwise(0.0) if k in s else F.lit(0.0)
    soft = F.when((F.col("max_t10") > 280) | (F.col("min_t10") < 50), 0.05).when((F.col("max_t10") > 260) | (F.col("min_t10") < 80), 0.03).otherwise(0.0)
    total = (
        F.col("base_rate") * 0.5
        + F.when(s["interval_expected"], 0.22).when(s["overdue"], 0.14).otherwise(0.0)
        + F.when(s["cluster_dense"], 0.15).when(s["cluster_moderate"], 0.08).when(F.col("recent") == 1, 0.03).otherwise(0.0)
        + F.when(s["precursor_strong"], 0.12).when(pct >= 33, 0.05).otherwise(0.0)
        + plus("rising_near_threshold", 0.10)
        + plus("dropping_near_threshold", 0.10)
        + soft
        + plus("status_flicker", 0.15)
        + plus("status_out_of_range", 0.12)
        + plus("status_fault_reported", 0.10)
    )
    fired = F.array_compact(F.array(*[F.when(s[k], F.lit(k)) for k in SIGNALS if k in s]))
    trigger = F.lit(False)
    for k in TRIGGERS:
        trigger = trigger | s[k] if k in s else trigger
    return f.select("sensor", "cp", F.round(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)), 6).alias("probability"), trigger.alias("predicted"), fired.alias("fired"), "has_anomaly")


def allowed(hits: int, misses: int) -> bool:
    """Whether a signal's record lets it trigger."""
    return hits + misses < WARM_UP or (hits + PRIOR_HITS) / (hits + misses + PRIOR_HITS + PRIOR_MISSES) >= LEAST


def gated(scored: DataFrame) -> DataFrame:
    """(sensor, cp, predicted): a signal triggers only while its record allows it.

    A signal's record at a checkpoint counts what it fired before and the truth one checkpoint later, whether or not
    it was let through. So records are running sums, and no fold is needed: windows in the JVM."""
    order = Window.partitionBy("sensor").orderBy("cp")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    truth = F.col("has_anomaly") == 1
    told = scored.select("sensor", "cp", "fired", "has_anomaly", F.lag("fired").over(order).alias("before"))
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(so_far), F.lit(0))
    had = {k: F.array_contains("before", k) for k in TRIGGERS}
    told = told.select("sensor", "cp", "fired", *[count(had[k] & truth).alias(f"h_{k}") for k in TRIGGERS], *[count(had[k] & ~truth).alias(f"m_{k}") for k in TRIGGERS])
    let = F.lit(False)
    for k in TRIGGERS:
        h, m = F.col(f"h_{k}"), F.col(f"m_{k}")
        may = (h + m < WARM_UP) | ((h + PRIOR_HITS) / (h + m + PRIOR_HITS + PRIOR_MISSES) >= LEAST)
        let = let | (F.array_contains("fired", k) & may)
    return told.select("sensor", "cp", let.alias("predicted"))


def explain(scored: DataFrame) -> DataFrame:
    """(sensor, signal, hits, misses, confidence): the record of every signal of each key, those that never fired too."""
    p = predictions(scored)
    keys = scored.select("sensor").distinct().withColumn("signal", F.explode(F.array(*map(F.lit, SIGNALS))))
    seen = p.select("sensor", "truth", F.explode("fired").alias("signal")).groupBy("sensor", "signal").agg(F.sum(F.col("truth").cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("fires"))
    out = keys.join(seen, ["sensor", "signal"], "left").fillna(0, ["hits", "fires"]).withColumn("misses", F.col("fires") - F.col("hits"))
    return out.select("sensor", "signal", "hits", "misses", F.round((F.col("hits") + PRIOR_HITS) / (F.col("fires") + PRIOR_HITS + PRIOR_MISSES), 3).alias("confidence"))


def state(r: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """(sensor, faults, first_fault, last_fault): what INIT creates, EVENT appends to and RESET (sensor, seq) empties. It is what a snapshot
    keeps; statuses seen are not part of it."""
    fault = (F.col("status") == "FAULT") & (F.lit(True) if resets is None else F.col("seq") > F.coalesce("_reset", F.lit(0)))
    if resets is not None:
        r = r.join(resets.groupBy("sensor").agg(F.max("seq").alias("_reset")), "sensor", "left")
    when = F.when(fault, F.col("minute"))
    return r.groupBy("sensor").agg(F.coalesce(F.sum(fault.cast("bigint")), F.lit(0)).alias("faults"), F.min(when).alias("first_fault"), F.max(when).alias("last_fault"))


def predictions(scored: DataFrame) -> DataFrame:
    """Each checkpoint's score with the next one's truth; the last has none."""
    truth = F.lead("has_anomaly").over(Window.partitionBy("sensor").orderBy("cp"))
    return scored.withColumn("truth", truth).filter("truth is not null")


def posterior(scored: DataFrame) -> DataFrame:
    """Record of each signal: fires, hits, misses and the mean of its Beta posterior, without a fold since sums don't depend on order."""
    p = predictions(scored).select("sensor", "truth", F.explode("fired").alias("signal"))
    out = p.groupBy("signal").agg(F.count(F.lit(1)).alias("fires"), F.sum(F.col("truth").cast("bigint")).alias("hits"))
    out = out.withColumn("misses", F.col("fires") - F.col("hits"))
    return out.withColumn("confidence", F.round((F.col("hits") + PRIOR_HITS) / (F.col("fires") + PRIOR_HITS + PRIOR_MISSES), 3))
