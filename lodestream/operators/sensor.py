"""Sensor readings: running statistics, checkpoint windows, trends, anomalies, encoders.

Readings have sensor, minute, seq (1-based order), t10 (tenths of a degree, so sums are exact), status and h10 (humidity in tenths).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds in tenths of a degree, and the names of states.
HIGH, LOW, ELEVATED, COOL = 280, 50, 260, 80
CHECKPOINT = 20


def readings(events: DataFrame) -> DataFrame:
    """Readings from an event log: the sensor is the user, the value modulo 40 the temperature."""
    status = F.when(F.col("event_type") == "error", "FAULT").when(F.col("event_type") == "signup", "NO_DATA").when(F.col("event_type") == "view", "OUT_OF_RANGE").otherwise("OK")
    return events.select(
        F.col("user_id").alias("sensor"),
        F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("minute"),
        F.expr("(cast(round(value * 100) as bigint) % 4000) div 10").alias("t10"),
        status.alias("status"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"),
        F.expr("cast(round(value * 100) as bigint) % 1000").alias("h10"),
    )


def anomalous(t10: Column | str = "t10") -> Column:
    t = F.col(t10) if isinstance(t10, str) else t10
    return (t > HIGH) | (t < LOW)


def ordered() -> Window:
    return Window.partitionBy("sensor").orderBy("seq")


def minutes(back: int) -> Window:
    return Window.partitionBy("sensor").orderBy("minute").rangeBetween(-back, 0)


def session_stats(r: DataFrame) -> DataFrame:
    """One row per sensor; partial sums are made before the shuffle, so a hot sensor costs nothing extra."""
    return r.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("t10").alias("sum_t10"),
        F.min("t10").alias("min_t10"),
        F.max("t10").alias("max_t10"),
        F.sum(anomalous().cast("bigint")).alias("anomalies"),
        F.max_by("t10", "seq").alias("latest_t10"),
        (F.sum("t10") / 10.0 / F.count(F.lit(1))).alias("avg_temp"),
    )


def running_stats(r: DataFrame) -> DataFrame:
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return r.select(
        "sensor", "seq", F.sum("t10").over(w).alias("sum_t10"), F.min("t10").over(w).alias("min_t10"), F.max("t10").over(w).alias("max_t10"), F.sum(anomalous().cast("bigint")).over(w).alias("anomalies")
    )


def checkpoints(r: DataFrame, size: int = CHECKPOINT) -> DataFrame:
    """Full windows of ``size`` readings: statistics and velocity (last - first) / size, in degrees."""
    out = r.withColumn("cp", F.floor((F.col("seq") - 1) / size)).groupBy("sensor", "cp")
    out = out.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("t10").alias("min_t10"),
        F.max("t10").alias("max_t10"),
        F.sum("t10").alias("sum_t10"),
        F.min_by("t10", "seq").alias("first_t10"),
        F.max_by("t10", "seq").alias("last_t10"),
        F.max("minute").alias("minute"),
        F.max(anomalous().cast("int")).alias("has_anomaly"),
        F.max((F.col("status") == "FAULT").cast("int")).alias("has_fault"),
    )
    return out.filter(F.col("n") == size).withColumn("velocity", F.round((F.col("last_t10") - F.col("first_t10")) / 10.0 / F.col("n"), 6))


def window_stats(r: DataFrame) -> DataFrame:
    """Over the last 20 minutes of each reading, which the window has; ``window_at`` takes any minute."""
    w = minutes(CHECKPOINT - 1)
    return r.select("sensor", "seq", F.min("t10").over(w).alias("min_t10"), F.max("t10").over(w).alias("max_t10"), (F.sum("t10").over(w) / 10.0 / F.count(F.lit(1)).over(w)).alias("avg_temp"))


def window_at(r: DataFrame, probes: DataFrame) -> DataFrame:
    """Statistics of the 20 minutes up to each probe (sensor, minute); 20.0 degrees each where a window has no reading.

    A range join by slots of 20 minutes: a probe meets only the readings of the two slots that its window touches."""
    slot = lambda c: F.floor(c / CHECKPOINT)
    first = F.col("minute") - (CHECKPOINT - 1)
    asked = probes.select("sensor", F.col("minute").alias("probe"), F.explode(F.array_distinct(F.array(slot(first), slot(F.col("minute"))))).alias("slot"))
    near = asked.join(r.select("sensor", "minute", "t10", slot(F.col("minute")).alias("slot")), ["sensor", "slot"]).filter(F.col("minute").between(F.col("probe") - (CHECKPOINT - 1), F.col("probe")))
    found = near.groupBy("sensor", F.col("probe").alias("minute")).agg(F.min("t10").alias("lo"), F.max("t10").alias("hi"), F.sum("t10").alias("total"), F.count(F.lit(1)).alias("n"))
    value = lambda c: F.coalesce(F.round(c, 6), F.lit(20.0))
    return probes.join(found, ["sensor", "minute"], "left").select("sensor", "minute", value(F.col("lo") / 10.0).alias("min"), value(F.col("hi") / 10.0).alias("max"), value(F.col("total") / 10.0 / F.col("n")).alias("avg"))


def degrees(t10: Column) -> Column:
    """Tenths as text with one decimal."""
    size = F.abs(t10).cast("bigint")
    return F.concat(F.when(t10 < 0, "-").otherwise(""), F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"))


def rounded(total: Column, n: Column) -> Column:
    """The mean of tenths as whole tenths, half up."""
    return F.floor(total / n + 0.5)


def recent_trend(r: DataFrame, last: int = 10) -> DataFrame:
    """Least-squares slope of the last readings (degrees a reading) and its name; under two readings it is stable."""
    w = ordered().rowsBetween(1 - last, 0)
    x, y = F.col("seq"), F.col("t10")
    n, sx, sy, sxy, sxx = (F.sum(e).over(w) for e in (F.lit(1), x, y, x * y, x * x))
    bottom = n * sxx - sx * sx
    out = r.select("sensor", "seq", F.when(bottom == 0, 0.0).otherwise(F.round((n * sxy - sx * sy) / 10.0 / F.nullif(bottom, F.lit(0)), 6) + 0.0).alias("slope"))
    return out.withColumn("trend", F.when(F.col("slope") > 0.15, "rising").when(F.col("slope") < -0.15, "falling").otherwise("stable"))


def velocity(r: DataFrame) -> DataFrame:
    """Change to the reading before (0 for the first) in tenths, with its urgency."""
    v = F.coalesce(F.col("t10") - F.lag("t10").over(ordered()), F.lit(0))
    out = r.select("sensor", "seq", "t10", v.alias("velocity_t10"))
    near_high, near_low = F.col("t10") >= 250, F.col("t10") <= 80
    v = F.col("velocity_t10")
    urgency = F.when((v > 20) & near_high, "rapid rise near fault").when((v < -20) & near_low, "rapid drop near dropout").when(v > 20, "rapid rise").when(v < -20, "rapid drop").when(v > 10, "fast rise").when(v < -10, "fast fall").otherwise("")
    return out.withColumn("urgency", urgency)


def last_values(r: DataFrame, last: int = 10) -> DataFrame:
    w = ordered().rowsBetween(1 - last, 0)
    return r.select("sensor", "seq", F.array_join(F.collect_list(F.col("t10").cast("string")).over(w), ",").alias("last_t10"))


def recent_anomalies(r: DataFrame) -> DataFrame:
    """Anomalies in the 21 minutes [t - 20, t]."""
    return r.select("sensor", "seq", F.sum(anomalous().cast("bigint")).over(minutes(20)).alias("anomalies"))


def anomaly_type(t10: Column) -> Column:
    return F.when(t10 > 320, "spike_high").when(t10 > HIGH, "spike_moderate").when(t10 < 20, "dropout_severe").when(t10 < LOW, "dropout").otherwise("oscillation")


def physical_state(low: Column, high: Column) -> Column:
    return F.when(high > HIGH, "FAULT_HIGH").when(low < LOW, "FAULT_LOW").when(high > ELEVATED, "ELEVATED").when(low < COOL, "COOL").otherwise("NORMAL")


def _before_faults(r: DataFrame) -> DataFrame:
    """(sensor, fault_seq) beside each reading 40 to 20 minutes before the fault.

    A range join on sensor and slot of 21 minutes: each fault meets only the readings of the two slots its window touches.
    """
    slot = lambda c: F.floor(c / 21)
    faults = r.filter("status = 'FAULT'").select("sensor", F.col("minute").alias("fault"), F.col("seq").alias("fault_seq"))
    faults = faults.withColumn("slot", F.explode(F.array_distinct(F.array(slot(F.col("fault") - 40), slot(F.col("fault") - 20)))))
    seen = r.select("sensor", "minute", "seq", "t10", slot(F.col("minute")).alias("slot"))
    return faults.join(seen, ["sensor", "slot"]).filter(F.col("minute").between(F.col("fault") - 40, F.col("fault") - 20))


def precursor_windows(r: DataFrame) -> DataFrame:
    """Statistics of the readings 40 to 20 minutes before each fault; faults without such readings are left out."""
    return _before_faults(r).groupBy("sensor", "fault_seq").agg(F.count(F.lit(1)).alias("n"), F.min("t10").alias("min_t10"), F.max("t10").alias("max_t10"), F.sum("t10").alias("sum_t10"))


def _precursor(n: Column, low: Column, high: Column, total: Column, velocity: Column) -> Column:
    """A window as array of four: highest, mean, velocity (two degrees a reading are 1) and anomaly flag."""
    flag = F.when((high > HIGH) | (low < LOW), 1.0).otherwise(0.0)
    return F.array(_unit(high), _unit(total / n), F.least(F.greatest(velocity / 2.0, F.lit(-1.0)), F.lit(1.0)), flag)


def precursor_match(r: DataFrame, cp: DataFrame, k: int = 3, last: int = 8, most: float = 0.35) -> DataFrame:
    """``cp`` with precursor_pct: of the ``k`` nearest windows before the key's ``last`` faults so far, those within cosine
    distance ``most``, as whole percent of ``k`` or of these faults if they are fewer. Faults without readings before them count as faults; 0 without faults."""
    vectors = encode_precursors(r).withColumnRenamed("fault_seq", "seq")
    faults = r.filter("status = 'FAULT'").select("sensor", "seq").join(vectors, ["sensor", "seq"], "left")
    known = faults.select("sensor", "seq", F.collect_list(F.struct("v")).over(ordered().rowsBetween(1 - last, 0)).alias("known"))
    so_far = ordered().rowsBetween(Window.unboundedPreceding, 0)
    told = r.select("sensor", "seq").join(known, ["sensor", "seq"], "left").select("sensor", "seq", F.last("known", ignorenulls=True).over(so_far).alias("known"))
    ends = told.filter(F.col("seq") % CHECKPOINT == 0).select("sensor", F.floor((F.col("seq") - 1) / CHECKPOINT).alias("cp"), F.coalesce("known", F.array().cast("array<struct<v:array<double>>>")).alias("known"))
    dot = lambda a, b: sum((a[j] * b[j] for j in range(1, 4)), a[0] * b[0])
    q = _precursor(F.col("n"), F.col("min_t10"), F.col("max_t10"), F.col("sum_t10"), F.col("velocity"))
    length = lambda x: F.sqrt(dot(q, q) * dot(x, x))
    distance = lambda x: 1.0 - F.when(length(x) > 0, dot(q, x) / F.nullif(length(x), F.lit(0.0))).otherwise(0.0)
    near = F.least(F.size(F.filter("known", lambda x: x["v"].isNotNull() & (F.round(distance(x["v"]), 6) <= most))), F.lit(k))
    pct = F.when(F.size("known") == 0, 0).otherwise(F.floor(near * 100 / F.greatest(F.least(F.size("known"), F.lit(k)), F.lit(1))))
    return cp.join(ends, ["sensor", "cp"]).withColumn("precursor_pct", pct.cast("int")).drop("known")


def _unit(t10: Column) -> Column:
    return F.round(F.least(F.greatest((t10 / 10.0 - 20.0) / 20.0, F.lit(-1.0)), F.lit(1.0)), 6)


def encode_precursors(r: DataFrame) -> DataFrame:
    """Vectors of four of the windows before faults: highest, mean, half the velocity, anomaly flag."""
    first, final = F.min_by("t10", "seq"), F.max_by("t10", "seq")
    stats = _before_faults(r).groupBy("sensor", "fault_seq").agg(F.count(F.lit(1)).alias("n"), F.min("t10").alias("lo"), F.max("t10").alias("hi"), F.sum("t10").alias("total"), (final - first).alias("rise"))
    v = _precursor(F.col("n"), F.col("lo"), F.col("hi"), F.col("total"), F.col("rise") / 10.0 / F.col("n"))
    return stats.select("sensor", "fault_seq", v.alias("v"))


def encode_windows(cp: DataFrame) -> DataFrame:
    """Checkpoint vectors of four: highest, mean, high-fault and low-fault flag."""
    return cp.select(
        "sensor", "cp", _unit(F.col("max_t10")).alias("v0"), _unit(F.col("sum_t10") / F.col("n")).alias("v1"), (F.col("max_t10") > HIGH).cast("int").alias("v2"), (F.col("min_t10") < LOW).cast("int").alias("v3")
    )


def encode_readings(r: DataFrame) -> DataFrame:
    """Reading vectors of four: temperature, sine and cosine of the minute in a round of 200, anomaly flag."""
    angle = F.col("minute") * (2.0 * 3.141592653589793) / 200.0
    return r.select("sensor", "seq", _unit(F.col("t10")).alias("v0"), (F.round(F.sin(angle), 6) + 0.0).alias("v1"), (F.round(F.cos(angle), 6) + 0.0).alias("v2"), anomalous().cast("int").alias("v3"))


def replicate(r: DataFrame, cycles: int) -> DataFrame:
    """The readings ``cycles`` times, each round later by the length of the data; status is dropped."""
    span = r.agg(F.max("minute") + 1).first()[0] or 0
    return r.drop("status").withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))).withColumn("minute", F.col("minute") + F.col("cycle") * span)
