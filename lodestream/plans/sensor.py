"""Queries over sensor readings and fault scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import faults as T
from ..operators import metrics as M
from ..operators import sensor as S
from .common import table

READINGS = """
readings AS (
  SELECT user_id AS sensor, CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 AS minute,
         (CAST(round(value * 100) AS BIGINT) % 4000) // 10 AS t10,
         CASE event_type WHEN 'error' THEN 'FAULT' WHEN 'signup' THEN 'NO_DATA' WHEN 'view' THEN 'OUT_OF_RANGE' ELSE 'OK' END AS status,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(round(value * 100) AS BIGINT) % 1000 AS h10
  FROM events)"""
WITH = f"WITH {READINGS}"
ANOM = "CASE WHEN t10 > 280 OR t10 < 50 THEN 1 ELSE 0 END"
CHECKPOINTS = f"""
cps AS (
  SELECT sensor, (seq - 1) // 20 AS cp, count(*) AS n, min(t10) AS min_t10, max(t10) AS max_t10, CAST(sum(t10) AS BIGINT) AS sum_t10,
         arg_min(t10, seq) AS first_t10, arg_max(t10, seq) AS last_t10, max(minute) AS minute, CAST(max({ANOM}) AS INTEGER) AS has_anomaly,
         CAST(max(CASE WHEN status = 'FAULT' THEN 1 ELSE 0 END) AS INTEGER) AS has_fault
  FROM readings GROUP BY 1, 2 HAVING count(*) = 20),
cpv AS (SELECT *, round((last_t10 - first_t10) / 10.0 / n, 6) AS velocity FROM cps)"""
UNIT = "round(least(greatest(({x} / 10.0 - 20.0) / 20.0, -1.0), 1.0), 6)"
VECTOR = "[CAST(" + UNIT.format(x="{hi}") + " AS DOUBLE), CAST(" + UNIT.format(x="(CAST({total} AS DOUBLE) / {n})") + " AS DOUBLE), CAST(least(greatest({velocity} / 2.0, -1.0), 1.0) AS DOUBLE), CASE WHEN {hi} > 280 OR {lo} < 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END]"
VECTOR_PW = VECTOR.format(hi="pw.hi", lo="pw.lo", total="pw.total", n="pw.n", velocity="(CAST(pw.rise AS DOUBLE) / 10.0 / pw.n)")
VECTOR_CP = VECTOR.format(hi="c.max_t10", lo="c.min_t10", total="c.sum_t10", n="c.n", velocity="c.velocity")
FEATURES = f"""
told AS (
  SELECT r.*, CAST(sum(CASE WHEN status = 'FAULT' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS faults,
         min(CASE WHEN status = 'FAULT' THEN minute END) OVER w AS first_fault,
         max(CASE WHEN status = 'FAULT' THEN minute END) OVER w AS last_fault,
         CAST(sum(CASE WHEN status = 'FAULT' THEN 1 ELSE 0 END) OVER (PARTITION BY sensor ORDER BY minute RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent
  FROM readings r WINDOW w AS (PARTITION BY sensor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rings AS (
  SELECT a.sensor, (a.seq - 1) // 20 AS cp, count(*) FILTER (WHERE b.status = 'NO_DATA') AS no_data,
         count(*) FILTER (WHERE b.status = 'OUT_OF_RANGE') AS out_of_range, count(*) FILTER (WHERE b.status = 'FAULT') AS reported
  FROM readings a JOIN readings b ON a.sensor = b.sensor AND b.seq BETWEEN a.seq - 14 AND a.seq AND a.minute - b.minute <= 15
  WHERE a.seq % 20 = 0 GROUP BY 1, 2),
pw AS (
  SELECT f.sensor, f.seq, count(*) AS n, min(r.t10) AS lo, max(r.t10) AS hi, sum(r.t10) AS total, arg_max(r.t10, r.seq) - arg_min(r.t10, r.seq) AS rise
  FROM readings f JOIN readings r ON r.sensor = f.sensor AND r.minute BETWEEN f.minute - 40 AND f.minute - 20 WHERE f.status = 'FAULT' GROUP BY 1, 2),
fl AS (
  SELECT f.sensor, row_number() OVER (PARTITION BY f.sensor ORDER BY f.seq) AS k, CASE WHEN pw.n IS NOT NULL THEN {VECTOR_PW} END AS v
  FROM readings f LEFT JOIN pw ON pw.sensor = f.sensor AND pw.seq = f.seq WHERE f.status = 'FAULT'),
cq AS (SELECT c.sensor, c.cp, t.faults, {VECTOR_CP} AS q FROM cpv c JOIN told t ON t.sensor = c.sensor AND t.seq = (c.cp + 1) * 20),
nn AS (
  SELECT c.sensor, c.cp, CAST(CASE WHEN c.faults = 0 THEN 0 ELSE 100 * least(count(*) FILTER (WHERE round(1.0 - CASE WHEN list_dot_product(q, q) * list_dot_product(v, v) > 0
    THEN list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v)) ELSE 0.0 END, 6) <= 0.35), 3) // least(c.faults, 3) END AS INTEGER) AS precursor_pct
  FROM cq c LEFT JOIN fl ON fl.sensor = c.sensor AND fl.k BETWEEN c.faults - 7 AND c.faults AND fl.v IS NOT NULL GROUP BY c.sensor, c.cp, c.faults),
feats AS (
  SELECT c.*, nn.precursor_pct, t.faults, t.recent, g.no_data, g.out_of_range, g.reported,
         round(coalesce(CASE WHEN t.faults >= 2 AND t.last_fault > t.first_fault
               THEN (c.minute - t.last_fault) / (CAST(t.last_fault - t.first_fault AS DOUBLE) / (t.faults - 1)) END, 0.0), 6) AS interval_ratio,
         round(CASE WHEN (c.minute + 1) // 20 >= 3 THEN CAST(t.faults AS DOUBLE) / ((c.minute + 1) // 20) ELSE 0.30 END, 6) AS base_rate
  FROM cpv c JOIN told t ON t.sensor = c.sensor AND t.seq = (c.cp + 1) * 20 JOIN rings g ON g.sensor = c.sensor AND g.cp = c.cp JOIN nn ON nn.sensor = c.sensor AND nn.cp = c.cp)"""
SCORED = """
sig AS (
  SELECT *, interval_ratio BETWEEN 0.8 AND 1.4 AS s_exp, interval_ratio > 1.5 AS s_over, recent >= 3 AS s_dense, recent = 2 AS s_mod,
         velocity > 1.5 AND max_t10 > 250 AS s_rise, velocity < -1.5 AND min_t10 < 100 AS s_drop,
         precursor_pct >= 67 AS s_pre, no_data >= 2 AS s_flick, out_of_range >= 2 AS s_range, reported >= 1 AS s_rep FROM feats),
parts AS (
  SELECT *, base_rate * 0.5 + CASE WHEN s_exp THEN 0.22 WHEN s_over THEN 0.14 ELSE 0 END
           + CASE WHEN s_dense THEN 0.15 WHEN s_mod THEN 0.08 WHEN recent = 1 THEN 0.03 ELSE 0 END
           + CASE WHEN s_pre THEN 0.12 WHEN precursor_pct >= 33 THEN 0.05 ELSE 0 END
           + CASE WHEN s_rise THEN 0.10 ELSE 0 END + CASE WHEN s_drop THEN 0.10 ELSE 0 END
           + CASE WHEN max_t10 > 280 OR min_t10 < 50 THEN 0.05 WHEN max_t10 > 260 OR min_t10 < 80 THEN 0.03 ELSE 0 END AS old,
         CASE WHEN s_flick THEN 0.15 ELSE 0 END + CASE WHEN s_range THEN 0.12 ELSE 0 END + CASE WHEN s_rep THEN 0.10 ELSE 0 END AS by_status FROM sig),
scored AS (
  SELECT sensor, cp, has_anomaly, s_exp, s_over, s_dense, s_mod, s_pre, s_rise, s_drop, s_flick, s_range, s_rep,
         round(greatest(least(old + by_status, 1.0), 0.0), 6) AS probability, round(greatest(least(old, 1.0), 0.0), 6) AS probability_old,
         s_exp OR s_over OR s_pre OR s_rise OR s_drop OR s_flick OR s_range AS predicted FROM parts)"""
ALL = f"{WITH}, {CHECKPOINTS}, {FEATURES}, {SCORED}"
TRUTH = "pred AS (SELECT * FROM (SELECT *, lead(has_anomaly) OVER (PARTITION BY sensor ORDER BY cp) AS truth FROM scored) WHERE truth IS NOT NULL)"
SWEEP = """
sweep AS (
  SELECT g.step, round(g.step / 20.0, 6) AS threshold,
         CAST(count(*) FILTER (WHERE hit AND truth = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE hit AND truth = 0) AS BIGINT) AS fp,
         CAST(count(*) FILTER (WHERE NOT hit AND truth = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE NOT hit AND truth = 0) AS BIGINT) AS tn
  FROM (SELECT g.step, p.truth, floor(round(p.probability * 20, 6)) >= g.step AS hit FROM range(21) g(step), pred p) g GROUP BY 1),
rates AS (
  SELECT threshold, tp, fp, fn, tn, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(CAST(tp AS DOUBLE) / (tp + fn), 6) END AS recall,
         CASE WHEN fp + tn = 0 THEN 0.0 ELSE round(CAST(fp AS DOUBLE) / (fp + tn), 6) END AS fpr,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(CAST(tp AS DOUBLE) / (tp + fp), 6) END AS precision FROM sweep)"""


def _readings(spark, d):
    return S.readings(table(spark, d, "events"))


def _over(f):
    return lambda spark, d: f(_readings(spark, d))


def scored_readings(r, statuses: bool = True):
    """All signals of all checkpoints of the readings, the match with windows before earlier faults among them."""
    return T.score(T.features(r, S.precursor_match(r, S.checkpoints(r))), F.col("precursor_pct"), statuses)


def _features(spark, d):
    r = _readings(spark, d)
    return T.features(r, S.precursor_match(r, S.checkpoints(r)))


def _scored(spark, d):
    return scored_readings(_readings(spark, d))


def _checkpoint_columns(df):
    return df.select("sensor", "cp", "n", "min_t10", "max_t10", "sum_t10", "first_t10", "last_t10", "minute", "has_anomaly", "has_fault", "velocity")


def anomaly_types(spark, d):
    r = _readings(spark, d).filter(S.anomalous())
    return r.groupBy("sensor", S.anomaly_type(F.col("t10")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def anomaly_cardinality(spark, d):
    r = _readings(spark, d).filter(S.anomalous())
    return r.groupBy("sensor").agg(F.count_distinct("minute").alias("minutes"), F.count_distinct(S.anomaly_type(F.col("t10"))).alias("kinds"))


def _close(estimate, exact):
    """Within 6.5 % of the count, four standard errors of a sketch of 4,096 registers, or within one."""
    return F.abs(estimate - exact) <= F.greatest(exact * 0.065, F.lit(1.0))


def anomaly_cardinality_hll(spark, d):
    """Distinct minutes with an anomaly by a sketch, beside the exact count: whether the estimate keeps its bound."""
    r = _readings(spark, d).filter(S.anomalous()).groupBy("sensor")
    both = r.agg(F.hll_sketch_estimate(F.hll_sketch_agg("minute", F.lit(12))).alias("estimate"), F.count_distinct("minute").alias("minutes"))
    return both.select("sensor", "minutes", _close(F.col("estimate"), F.col("minutes")).alias("close"))


def hll_union(spark, d):
    """Sketches per sensor and status, merged per status: whether the estimate of their union keeps its bound around the exact count."""
    r = _readings(spark, d)
    parts = r.groupBy("sensor", "status").agg(F.hll_sketch_agg("minute", F.lit(12)).alias("sketch"))
    merged = parts.groupBy("status").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    both = merged.join(r.groupBy("status").agg(F.count_distinct("minute").alias("minutes")), "status")
    return both.select("status", "minutes", _close(F.col("estimate"), F.col("minutes")).alias("close"))


def physical_states(spark, d):
    c = S.checkpoints(_readings(spark, d))
    return c.groupBy(S.physical_state(F.col("min_t10"), F.col("max_t10")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def context_block(spark, d):
    """What a context has of each sensor: totals, and its last anomaly's minute."""
    r = _readings(spark, d)
    return r.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("t10", "seq").alias("latest_t10"),
        (F.sum("t10") / 10.0 / F.count(F.lit(1))).alias("avg_temp"),
        F.max(F.when(S.anomalous(), F.col("minute"))).alias("last_anomaly"),
        F.sum(F.when(F.col("status") != "OK", 1).otherwise(0)).alias("not_ok"),
    )


def signal_flags(spark, d):
    scored = _scored(spark, d)
    return scored.select("sensor", "cp", "probability", "predicted", F.array_join("fired", ",").alias("fired"))


def tfi_features(spark, d):
    return _features(spark, d).select("sensor", "cp", "faults", "recent", "no_data", "out_of_range", "reported", "interval_ratio", "base_rate", "precursor_pct")


def tfi_gated(spark, d):
    return T.gated(_scored(spark, d))


def tfi_old(spark, d):
    """The older engine: no status signals, no gate."""
    scored = scored_readings(_readings(spark, d), statuses=False)
    return scored.select("sensor", "cp", "probability", "predicted", F.array_join("fired", ",").alias("fired"))


def tfi_explain(spark, d):
    return T.explain(_scored(spark, d))


def tfi_reset(spark, d):
    """Fault state of every sensor since its last purchase before minute 20000, which resets it."""
    resets = table(spark, d, "events")
    r = _readings(spark, d)
    bought = resets.filter("event_type = 'purchase'").select("event_id", "ts", "user_id")
    seen = r.join(bought.select(F.col("user_id").alias("sensor"), F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("minute")).distinct(), ["sensor", "minute"], "left_semi")
    return T.state(r, seen.filter("status = 'OK' and minute < 20000").select("sensor", "seq"))


def status_parse(spark, d):
    """Statuses by name from raw words, one of them unknown, one a calibration error."""
    kind = F.col("event_type")
    raw = F.when(kind == "error", "FAULT").when(kind == "click", "CALIB_ERROR").when(kind == "view", "fault").when(kind == "signup", "NO_DATA")
    return table(spark, d, "events").groupBy(T.parse_status(raw).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def window_at_probe(spark, d):
    """Five minutes of each sensor; most windows have no reading."""
    r = _readings(spark, d)
    probes = r.groupBy("sensor").agg(F.max("minute").alias("last")).select("sensor", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(9000).cast("bigint"), F.col("last") - 30, F.col("last"), F.col("last") + 19)).alias("minute")).distinct()
    return S.window_at(r, probes)


def encode_precursors(spark, d):
    v = S.encode_precursors(_readings(spark, d))
    return v.select("sensor", "fault_seq", *[(F.round(F.get("v", F.lit(k)), 6) + 0.0).alias(f"v{k}") for k in range(4)])


def _told(spark, d):
    """Each sensor's readings so far, in order, as one row: what a text on it needs."""
    r = _readings(spark, d)
    last = r.withColumn("end", F.max("seq").over(Window.partitionBy("sensor")))
    now = F.max_by("minute", "seq")
    return last.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("n"), F.sum("t10").alias("total"), F.min("t10").alias("lo"), F.max("t10").alias("hi"), now.alias("now"),
        F.sum(S.anomalous().cast("bigint")).alias("anomalies"),
        F.array_sort(F.collect_list(F.when(F.col("seq") > F.col("end") - 10, F.struct("seq", "t10")))).alias("recent"),
        F.array_sort(F.collect_list(F.when(S.anomalous(), F.struct("seq", "minute")))).alias("odd"),
    )


def context_text(spark, d):
    """The context block of each sensor as text, at its last reading, for 2000 minutes."""
    t = _told(spark, d)
    temps = F.array_join(F.transform("recent", lambda x: S.degrees(x["t10"])), ", ")
    n = F.size("recent")
    sums = [F.aggregate(F.transform("recent", f), F.lit(0.0), lambda a, x: a + x) for f in (lambda x, i: i * x["t10"] / 10.0, lambda x, i: x["t10"] / 10.0)]
    slope = (n * sums[0] - (n * (n - 1) / 2) * sums[1]) / F.nullif(n * (n * (n - 1) * (2 * n - 1) / 6) - (n * (n - 1) / 2) * (n * (n - 1) / 2), F.lit(0.0))
    trend = F.when(F.round(slope, 6) > 0.15, "rising").when(F.round(slope, 6) < -0.15, "falling").otherwise("stable")
    near = F.transform(F.filter("odd", lambda x: x["minute"] >= F.greatest(F.col("now") - 2000, F.lit(0))), lambda x: x["minute"].cast("string"))
    lines = [
        F.concat(F.lit("Last "), n.cast("string"), F.lit(" temperatures (oldest→newest, °C): "), temps),
        F.concat(F.lit("Recent trend: "), trend),
        F.concat(F.lit("Aggregate over "), F.col("n").cast("string"), F.lit(" readings: avg="), S.degrees(S.rounded(F.col("total"), F.col("n"))), F.lit("°C, min="), S.degrees(F.col("lo")), F.lit("°C, max="), S.degrees(F.col("hi")), F.lit("°C")),
        F.concat(F.lit("Total anomalies detected so far: "), F.col("anomalies").cast("string")),
        F.when(F.size(near) == 0, F.lit("No anomalies in the last 2000 minutes.")).otherwise(F.concat(F.lit("Anomalous time indices in the last 2000 minutes (minute numbers, not temperatures): ["), F.array_join(near, ", "), F.lit("]"))),
    ]
    return t.select("sensor", F.concat_ws("\n", *lines).alias("context"))


def synthesis_text(spark, d):
    """The synthesis block of each sensor as text: totals and all anomalous minutes."""
    t = _told(spark, d)
    lines = [
        F.lit("=== Full Session Stats ==="),
        F.concat(F.lit("Total readings: "), F.col("n").cast("string")),
        F.concat(F.lit("Temperature range: "), S.degrees(F.col("lo")), F.lit("°C to "), S.degrees(F.col("hi")), F.lit("°C (avg "), S.degrees(S.rounded(F.col("total"), F.col("n"))), F.lit("°C)")),
        F.concat(F.lit("Total anomalies detected: "), F.col("anomalies").cast("string")),
        F.when(F.size("odd") > 0, F.concat(F.lit("Anomalous time indices (minute numbers, not temperatures): ["), F.array_join(F.transform("odd", lambda x: x["minute"].cast("string")), ", "), F.lit("]"))),
    ]
    return t.select("sensor", F.concat_ws("\n", *lines).alias("context"))


def prediction_context(spark, d):
    """What a prediction at each checkpoint is told: state, fault history and the match with windows before earlier faults."""
    f = _features(spark, d)
    state = S.physical_state(F.col("min_t10"), F.col("max_t10"))
    brief = F.concat(F.lit("Window [t-19..t] stats: min="), S.degrees(F.col("min_t10")), F.lit("°C max="), S.degrees(F.col("max_t10")), F.lit("°C avg="), S.degrees(S.rounded(F.col("sum_t10"), F.col("n"))), F.lit("°C\nState: "), state)
    history = F.when(F.col("faults") > 0, F.concat(F.lit("Confirmed faults so far: "), F.col("faults").cast("string"), F.lit("\nFaults in last 3 checkpoints: "), F.col("recent").cast("string")))
    k = F.least(F.col("faults"), F.lit(3))
    memory = F.when(F.col("precursor_pct") > 0, F.concat(F.lit("Match rate: "), F.col("precursor_pct").cast("string"), F.lit("% of "), k.cast("string"), F.lit(" closest neighbors")))
    return f.select("sensor", "cp", F.concat_ws("\n\n", brief, history, memory).alias("context"))


def report_text(spark, d):
    """Reports on each checkpoint, written from the one before it, scored on what they say: numbers and pattern words are read from the text."""
    r = _readings(spark, d).withColumn("cp", F.floor((F.col("seq") - 1) / 20))
    c = r.groupBy("sensor", "cp").agg(F.count(F.lit(1)).alias("n"), F.sum(S.anomalous().cast("bigint")).alias("k"), F.max("t10").alias("hi"), F.min("t10").alias("lo")).filter("n = 20")
    w = Window.partitionBy("sensor").orderBy("cp")
    said = c.withColumns({x + "0": F.lag(x).over(w) for x in ("k", "hi", "lo")}).filter("k0 is not null")
    words = F.concat_ws(" and ", F.when(F.col("hi0") > 320, "SPIKE"), F.when(F.col("lo0") < 20, "Dropout"), F.when(F.col("k0") > 9, "drift"))
    lowest = F.when(F.col("lo0") < 100, F.concat(F.lit(', "min_temp": '), S.degrees(F.col("lo0")))).otherwise("")
    text = F.concat(F.lit('{"total_faults": '), F.col("k0").cast("string"), F.lit(', "max_temp": '), S.degrees(F.col("hi0")), lowest, F.lit(', "patterns": "'), words, F.lit('"}'))
    score = M.report_score(text, F.col("k"), F.col("hi") / 10.0)
    return said.select("sensor", "cp", score.alias("s")).select("sensor", "cp", "s.*")


def questions(spark, d):
    """Ground truths of all thirty questions for each sensor: on its reading 31, on reading 41 with the ten before it, and on all. Numbers are whole tenths."""
    r = _readings(spark, d)
    seq, t, h = F.col("seq"), F.col("t10"), F.col("h10")
    late = r.withColumn("end", F.max("seq").over(Window.partitionBy("sensor")))
    cur, probe, ten, five = seq == 31, seq == 41, seq.between(31, 40), seq.between(36, 40)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))

    def slope(part):
        x, y = F.when(part, seq), F.when(part, t)
        n, sx, sy, sxy, sxx = (F.sum(e) for e in (F.when(part, 1), x, y, x * y, x * x))
        return F.round((n * sxy - sx * sy) / 10.0 / F.nullif(n * sxx - sx * sx, F.lit(0)), 6)

    a = late.groupBy("sensor").agg(
        F.max(F.when(cur, t)).alias("c"), F.max(F.when(cur, h)).alias("h"), F.max(F.when(probe, t)).alias("p"), F.max(F.when(seq == 40, t)).alias("p1"), slope(ten).alias("s10"), slope(five).alias("s5"),
        count(ten & S.anomalous()).alias("odd10"), F.max(F.when(ten, t)).alias("max10"), F.sum(F.when(ten, t)).alias("sum10"), count(ten & t.between(180, 270)).alias("fine10"), count(ten & (t > 230)).alias("warm10"),
        count(S.anomalous()).alias("odd"), F.sum("t10").alias("total"), F.count(F.lit(1)).alias("n"), F.max("t10").alias("hi"), F.min("t10").alias("lo"), count(S.anomalous() & (seq > F.col("end") - 20)).alias("odd20"), count(t > 280).alias("above"),
    ).filter("p is not null")  # sensors with too few readings have no recent window
    yes = lambda c: F.when(c, "yes").otherwise("no")
    trend = lambda c: F.when(c > 0.15, "increasing").when(c < -0.15, "decreasing").otherwise("stable")
    c, hum, p, avg10, avg = F.col("c"), F.col("h"), F.col("p"), F.floor(F.col("sum10") / 10 + 0.5), S.rounded(F.col("total"), F.col("n"))
    answers = {
        "cur_01": c, "cur_02": yes(c > 250), "cur_03": yes(hum > 500), "cur_04": yes(c.between(180, 270)), "cur_05": F.floor(c / 10 + 0.5), "cur_06": F.when(c > 200, "above").otherwise("below"),
        "cur_07": c - 220, "cur_08": yes(S.anomalous(c)), "cur_09": yes(hum.between(300, 700)), "cur_10": F.when(c < 180, "cold").when(c > 270, "hot").otherwise("normal"),
        "rec_01": trend(F.col("s10")), "rec_02": yes(F.col("odd10") > 0), "rec_03": F.col("odd10"), "rec_04": F.col("max10"), "rec_05": avg10, "rec_06": trend(F.col("s5")),
        "rec_07": yes(F.col("fine10") == 10), "rec_08": F.when(F.col("p1") > p, "higher").otherwise("lower"), "rec_09": yes(p > avg10), "rec_10": F.col("warm10"),
        "lng_01": F.col("odd"), "lng_02": avg, "lng_03": F.col("hi"), "lng_04": F.col("lo"), "lng_05": yes(F.col("odd20") > 0), "lng_06": F.col("above"), "lng_07": yes(avg > 230), "lng_08": yes(F.col("odd") > 5),
        "lng_09": F.col("hi") - F.col("lo"), "lng_10": yes(F.col("lo") < 50),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("question"), v.cast("string").alias("answer")) for k, v in answers.items()])
    return a.select("sensor", F.inline(rows))


def tfi_posterior(spark, d):
    return T.posterior(_scored(spark, d))


def detection_metrics(spark, d):
    p = T.predictions(_scored(spark, d))
    hit = F.col("predicted") | (F.col("probability") >= 0.5)
    count = lambda c: F.sum(c.cast("bigint"))
    out = p.agg(count(hit & (F.col("truth") == 1)).alias("tp"), count(hit & (F.col("truth") == 0)).alias("fp"), count(F.col("truth") == 1).alias("pos"), F.count(F.lit(1)).alias("n"))
    return out.select("tp", "fp", "pos", "n", F.round(F.col("tp") / F.greatest("pos", F.lit(1)), 6).alias("recall"), F.round(F.col("fp") / F.greatest(F.col("n") - F.col("pos"), F.lit(1)), 6).alias("fpr"))


def sweep(spark, d):
    return M.threshold_sweep(T.predictions(_scored(spark, d)))


def roc_auc(spark, d):
    return M.auc(sweep(spark, d))


def percentiles(low):
    return lambda spark, d: M.ranked_percentiles(_readings(spark, d), "sensor", "t10", (0.5, 0.95, 0.99), low)


def percentile_linear(spark, d):
    r = _readings(spark, d)
    return r.groupBy("sensor").agg(*[F.round(F.percentile("t10", F.lit(p)), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)])


def mean_std(spark, d):
    r = _readings(spark, d)
    n, s, q = F.count(F.lit(1)), F.sum("t10"), F.sum(F.col("t10") * F.col("t10"))
    var = F.when(n < 2, 0.0).otherwise((n * q - s * s) / F.nullif(n * (n - 1), F.lit(0)))
    return r.groupBy("sensor").agg(F.round(s / n, 6).alias("mean"), F.round(F.sqrt(var), 6).alias("std"), F.round(F.sqrt(var / n), 6).alias("stderr"))


def _drawn_rows(spark, d):
    return _readings(spark, d).withColumn("row_id", F.concat_ws(":", "sensor", "seq"))


def bootstrap_mean_ci(spark, d):
    return _six(M.bootstrap_mean(_drawn_rows(spark, d), "status", "t10", 100))


def _ratio_rows(spark, d):
    """Highest and lowest value of each checkpoint, as two results of one question id."""
    c = S.checkpoints(_readings(spark, d)).select(F.concat_ws(":", "sensor", "cp").alias("qid"), F.col("max_t10").cast("double").alias("hi"), F.col("min_t10").cast("double").alias("lo"))
    return M.paired(c.select("qid", F.col("hi").alias("value")), c.select("qid", F.col("lo").alias("value")))


def _six(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def bootstrap_paired_ratio(spark, d):
    return _six(M.bootstrap_ratio(_ratio_rows(spark, d), 100))


def bootstrap_median_ratio(spark, d):
    return _six(M.bootstrap_median_ratio(_ratio_rows(spark, d), 100))


def bootstrap_cross_run(spark, d):
    """The median over runs (days) of each status' daily median."""
    r = _readings(spark, d).groupBy("status", F.floor(F.col("minute") / 1440).alias("day")).agg(F.percentile("t10", F.lit(0.5)).alias("p50"))
    return _six(M.bootstrap_quantile(r.withColumn("row_id", F.concat_ws(":", "status", "day")), "status", "p50", 0.5))


def bootstrap_quantile(spark, d):
    return _six(M.bootstrap_quantile(_drawn_rows(spark, d), "status", "t10", 0.5))


def sensor_window_tool(spark, d):
    """Windows with an anomaly in a range of minutes: ids by range first, then their rows."""
    c = _checkpoint_columns(S.checkpoints(_readings(spark, d)))
    ids = c.filter("has_anomaly = 1 and minute between 10000 and 30000").select("sensor", "cp")
    return c.join(ids, ["sensor", "cp"]).select("sensor", "cp", "minute", "max_t10", "min_t10")


def precursor_knn(spark, d):
    """Per checkpoint: of the three nearest of the windows before the last eight faults, the share within cosine distance 0.35."""
    r = _readings(spark, d)
    return S.precursor_match(r, S.checkpoints(r)).select("sensor", "cp", "precursor_pct")


def replicate(spark, d):
    r = S.replicate(_readings(spark, d), 3)
    return r.groupBy("sensor", "cycle").agg(F.count(F.lit(1)).alias("n"), F.min("minute").alias("first"), F.max("minute").alias("last"))


PRE = """
pre AS (SELECT f.sensor, f.seq AS fault_seq, count(*) AS n, min(r.t10) AS min_t10, max(r.t10) AS max_t10, CAST(sum(r.t10) AS BIGINT) AS sum_t10
  FROM readings f JOIN readings r ON r.sensor = f.sensor AND r.minute BETWEEN f.minute - 40 AND f.minute - 20
  WHERE f.status = 'FAULT' GROUP BY 1, 2)"""
SIGNAL_SQL = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in zip(("s_exp", "s_over", "s_dense", "s_mod", "s_pre", "s_rise", "s_drop", "s_flick", "s_range", "s_rep"), T.SIGNALS, strict=True))
TRIGGERS = ("s_exp", "s_over", "s_pre", "s_rise", "s_drop", "s_flick", "s_range")
GATED = f"""{ALL}, b AS (SELECT sensor, cp, has_anomaly, {', '.join(f'{c}, coalesce(lag({c}) OVER w, FALSE) AS b{c}' for c in TRIGGERS)} FROM scored WINDOW w AS (PARTITION BY sensor ORDER BY cp)),
g AS (SELECT *, {', '.join(f'count(*) FILTER (WHERE b{c} AND has_anomaly = 1) OVER w AS h{c}, count(*) FILTER (WHERE b{c} AND has_anomaly = 0) OVER w AS m{c}' for c in TRIGGERS)} FROM b WINDOW w AS (PARTITION BY sensor ORDER BY cp ROWS UNBOUNDED PRECEDING))
SELECT sensor, cp, {' OR '.join(f'({c} AND (h{c} + m{c} < 2 OR (h{c} + 2.0) / (h{c} + m{c} + 5.0) >= 0.30))' for c in TRIGGERS)} AS predicted FROM g"""
EXPLAIN = f"""{ALL}, {TRUTH}, hit AS (SELECT sensor, unnest(list_filter([{SIGNAL_SQL}], lambda x: x IS NOT NULL)) AS signal, truth FROM pred),
n AS (SELECT sensor, signal, CAST(sum(truth) AS BIGINT) AS hits, count(*) AS fires FROM hit GROUP BY 1, 2), k AS (SELECT DISTINCT sensor, unnest({list(T.SIGNALS)}) AS signal FROM scored)
SELECT k.sensor, k.signal, coalesce(hits, 0) AS hits, coalesce(fires - hits, 0) AS misses, round((coalesce(hits, 0) + 2.0) / (coalesce(fires, 0) + 5.0), 3) AS confidence FROM k LEFT JOIN n ON n.sensor = k.sensor AND n.signal = k.signal"""
DEG = "(CAST({x} AS BIGINT) // 10 || '.' || CAST({x} AS BIGINT) % 10)"
AVG = DEG.format(x="floor(CAST({t} AS DOUBLE) / {n} + 0.5)")
TOLD = f"""{WITH}, z AS (SELECT *, max(seq) OVER (PARTITION BY sensor) AS fin FROM readings),
told AS (SELECT sensor, count(*) AS n, sum(t10) AS total, min(t10) AS lo, max(t10) AS hi, arg_max(minute, seq) AS now, sum({ANOM}) AS anomalies,
  string_agg({DEG.format(x='t10')}, ', ' ORDER BY seq) FILTER (WHERE seq > fin - 10) AS temps, count(*) FILTER (WHERE seq > fin - 10) AS recent, regr_slope(t10 / 10.0, seq) FILTER (WHERE seq > fin - 10) AS slope,
  string_agg(minute, ', ' ORDER BY seq) FILTER (WHERE {ANOM} = 1) AS odd FROM z GROUP BY 1),
near AS (SELECT t.sensor, string_agg(r.minute, ', ' ORDER BY r.seq) AS near FROM told t JOIN readings r ON r.sensor = t.sensor AND r.minute >= greatest(t.now - 2000, 0) AND (r.t10 > 280 OR r.t10 < 50) GROUP BY 1)"""
CONTEXTS = f"""{TOLD} SELECT told.sensor, 'Last ' || recent || ' temperatures (oldest→newest, °C): ' || temps || chr(10) || 'Recent trend: ' || CASE WHEN round(slope, 6) > 0.15 THEN 'rising' WHEN round(slope, 6) < -0.15 THEN 'falling' ELSE 'stable' END || chr(10)
|| 'Aggregate over ' || n || ' readings: avg=' || {AVG.format(t='total', n='n')} || '°C, min=' || {DEG.format(x='lo')} || '°C, max=' || {DEG.format(x='hi')} || '°C' || chr(10) || 'Total anomalies detected so far: ' || anomalies || chr(10)
|| CASE WHEN near IS NULL THEN 'No anomalies in the last 2000 minutes.' ELSE 'Anomalous time indices in the last 2000 minutes (minute numbers, not temperatures): [' || near || ']' END AS context FROM told LEFT JOIN near ON near.sensor = told.sensor"""
SYNTHESIS = f"""{TOLD} SELECT sensor, '=== Full Session Stats ===' || chr(10) || 'Total readings: ' || n || chr(10) || 'Temperature range: ' || {DEG.format(x='lo')} || '°C to ' || {DEG.format(x='hi')} || '°C (avg ' || {AVG.format(t='total', n='n')} || '°C)' || chr(10)
|| 'Total anomalies detected: ' || anomalies || CASE WHEN odd IS NULL THEN '' ELSE chr(10) || 'Anomalous time indices (minute numbers, not temperatures): [' || odd || ']' END AS context FROM told"""
PREDICTIONS = f"""{WITH}, {CHECKPOINTS}, {FEATURES} SELECT sensor, cp, 'Window [t-19..t] stats: min=' || {DEG.format(x='min_t10')} || '°C max=' || {DEG.format(x='max_t10')} || '°C avg=' || {AVG.format(t='sum_t10', n='n')} || '°C' || chr(10) || 'State: '
|| CASE WHEN max_t10 > 280 THEN 'FAULT_HIGH' WHEN min_t10 < 50 THEN 'FAULT_LOW' WHEN max_t10 > 260 THEN 'ELEVATED' WHEN min_t10 < 80 THEN 'COOL' ELSE 'NORMAL' END
|| CASE WHEN faults > 0 THEN chr(10) || chr(10) || 'Confirmed faults so far: ' || faults || chr(10) || 'Faults in last 3 checkpoints: ' || recent ELSE '' END
|| CASE WHEN precursor_pct > 0 THEN chr(10) || chr(10) || 'Match rate: ' || precursor_pct || '% of ' || least(faults, 3) || ' closest neighbors' ELSE '' END AS context FROM feats"""
REPORTS = f"""{WITH}, c AS (SELECT sensor, (seq - 1) // 20 AS cp, sum({ANOM}) AS k, max(t10) AS hi, min(t10) AS lo FROM readings GROUP BY 1, 2 HAVING count(*) = 20),
s AS (SELECT *, lag(k) OVER w AS k0, lag(hi) OVER w AS hi0, lag(lo) OVER w AS lo0 FROM c WINDOW w AS (PARTITION BY sensor ORDER BY cp))
SELECT sensor, cp, abs(k - k0) <= 3 AS count_ok, abs(hi - hi0) <= 20 AS max_ok, lo0 < 50 AS min_ok, CAST((hi0 > 320)::INT + (lo0 < 20)::INT + (k0 > 9)::INT AS INTEGER) AS patterns,
CAST((abs(k - k0) <= 3)::INT + (abs(hi - hi0) <= 20)::INT + (lo0 < 50)::INT AS INTEGER) AS consistency FROM s WHERE k0 IS NOT NULL"""
PROBES = f"""{WITH}, e AS (SELECT sensor, max(minute) AS fin FROM readings GROUP BY 1), p AS (SELECT DISTINCT sensor, unnest([0, 9000, fin - 30, fin, fin + 19]) AS minute FROM e)
SELECT p.sensor, CAST(p.minute AS BIGINT) AS minute, coalesce(round(min(t10) / 10.0, 6), 20.0) AS min, coalesce(round(max(t10) / 10.0, 6), 20.0) AS max, coalesce(round(sum(t10) / 10.0 / count(t10), 6), 20.0) AS avg
FROM p LEFT JOIN readings r ON r.sensor = p.sensor AND r.minute BETWEEN p.minute - 19 AND p.minute GROUP BY 1, 2"""
YES = "CASE WHEN {c} THEN 'yes' ELSE 'no' END"
TREND = "CASE WHEN round({c}, 6) > 0.15 THEN 'increasing' WHEN round({c}, 6) < -0.15 THEN 'decreasing' ELSE 'stable' END"
ANSWERS = {
    "cur_01": "c", "cur_02": YES.format(c="c > 250"), "cur_03": YES.format(c="h > 500"), "cur_04": YES.format(c="c BETWEEN 180 AND 270"), "cur_05": "CAST(floor(c / 10.0 + 0.5) AS BIGINT)", "cur_06": "CASE WHEN c > 200 THEN 'above' ELSE 'below' END",
    "cur_07": "c - 220", "cur_08": YES.format(c="c > 280 OR c < 50"), "cur_09": YES.format(c="h BETWEEN 300 AND 700"), "cur_10": "CASE WHEN c < 180 THEN 'cold' WHEN c > 270 THEN 'hot' ELSE 'normal' END",
    "rec_01": TREND.format(c="s10"), "rec_02": YES.format(c="odd10 > 0"), "rec_03": "odd10", "rec_04": "max10", "rec_05": "avg10", "rec_06": TREND.format(c="s5"), "rec_07": YES.format(c="fine10 = 10"),
    "rec_08": "CASE WHEN p1 > p THEN 'higher' ELSE 'lower' END", "rec_09": YES.format(c="p > avg10"), "rec_10": "warm10",
    "lng_01": "odd", "lng_02": "mean", "lng_03": "hi", "lng_04": "lo", "lng_05": YES.format(c="odd20 > 0"), "lng_06": "above", "lng_07": YES.format(c="mean > 230"), "lng_08": YES.format(c="odd > 5"), "lng_09": "hi - lo", "lng_10": YES.format(c="lo < 50"),
}
TEN, FIVE, ODD = "seq BETWEEN 31 AND 40", "seq BETWEEN 36 AND 40", "(t10 > 280 OR t10 < 50)"
QUESTIONS = f"""{WITH}, z AS (SELECT *, max(seq) OVER (PARTITION BY sensor) AS fin FROM readings),
a AS (SELECT sensor, max(t10) FILTER (WHERE seq = 31) AS c, max(h10) FILTER (WHERE seq = 31) AS h, max(t10) FILTER (WHERE seq = 41) AS p, max(t10) FILTER (WHERE seq = 40) AS p1,
  regr_slope(t10 / 10.0, seq) FILTER (WHERE {TEN}) AS s10, regr_slope(t10 / 10.0, seq) FILTER (WHERE {FIVE}) AS s5, count(*) FILTER (WHERE {TEN} AND {ODD}) AS odd10, max(t10) FILTER (WHERE {TEN}) AS max10,
  CAST(floor(sum(t10) FILTER (WHERE {TEN}) / 10.0 + 0.5) AS BIGINT) AS avg10, count(*) FILTER (WHERE {TEN} AND t10 BETWEEN 180 AND 270) AS fine10, count(*) FILTER (WHERE {TEN} AND t10 > 230) AS warm10,
  count(*) FILTER (WHERE {ODD}) AS odd, CAST(floor(CAST(sum(t10) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS mean, max(t10) AS hi, min(t10) AS lo, count(*) FILTER (WHERE {ODD} AND seq > fin - 20) AS odd20, count(*) FILTER (WHERE t10 > 280) AS above
  FROM z GROUP BY 1)
SELECT sensor, q.question, q.answer FROM (SELECT sensor, unnest([{', '.join(f"{{'question': '{k}', 'answer': CAST({v} AS VARCHAR)}}" for k, v in ANSWERS.items())}]) AS q FROM a WHERE p IS NOT NULL)"""
#: Rows drawn with replacement: Poisson weights from a hash of row and round.
MIX = "(xor({x}, {x} >> 16) * 73244475) % 4294967296"
DRAWN = "rows AS ({{rows}}), d AS (SELECT *, {weight} AS w FROM (SELECT *, xor(c, c >> 16) / 4294967296.0::DOUBLE AS u FROM (SELECT *, {c} AS c FROM (SELECT *, {b} AS b_ FROM (SELECT *, (h + round * 2654435769) % 4294967296 AS a_ FROM (SELECT *, CAST(('0x' || substr(md5(row_id), 1, 8)) AS BIGINT) AS h FROM rows), range(100) t(round))))))".format(
    weight=M.poisson_sql("u"), b=MIX.format(x="a_"), c=MIX.format(x="b_")
)
BOOT_QUANTILE = f"""{WITH}, {DRAWN}, s AS (SELECT status, round, x, sum(w) AS w FROM (SELECT status, round, x, w FROM d UNION ALL SELECT status, -1, x, 1 FROM rows) GROUP BY 1, 2, 3 HAVING sum(w) > 0),
c AS (SELECT *, sum(w) OVER (PARTITION BY status, round ORDER BY x) AS upto, sum(w) OVER (PARTITION BY status, round) AS n FROM s), q AS (SELECT status, round, CAST(min(x) AS DOUBLE) AS q FROM c WHERE upto >= n * 0.5 GROUP BY 1, 2)
SELECT status, max(q) FILTER (WHERE round < 0) AS value, round(quantile_cont(q, 0.025) FILTER (WHERE round >= 0), 6) AS low, round(quantile_cont(q, 0.975) FILTER (WHERE round >= 0), 6) AS high FROM q GROUP BY 1"""
RATIO_ROWS = "SELECT sensor || ':' || cp AS row_id, CAST(max_t10 AS DOUBLE) AS a, CAST(min_t10 AS DOUBLE) AS b FROM cpv"
LAST = "(PARTITION BY sensor ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
STATS = "count(*) AS n, CAST(sum(t10) AS BIGINT) AS sum_t10, min(t10) AS min_t10, max(t10) AS max_t10"

QUERIES = {
    "session_stats": (_over(S.session_stats), f"{WITH} SELECT sensor, {STATS}, CAST(sum({ANOM}) AS BIGINT) AS anomalies, arg_max(t10, seq) AS latest_t10, sum(t10) / 10.0 / count(*) AS avg_temp FROM readings GROUP BY sensor"),
    "running_stats": (
        _over(S.running_stats),
        f"{WITH} SELECT sensor, seq, CAST(sum(t10) OVER w AS BIGINT) AS sum_t10, min(t10) OVER w AS min_t10, max(t10) OVER w AS max_t10, CAST(sum({ANOM}) OVER w AS BIGINT) AS anomalies FROM readings WINDOW w AS (PARTITION BY sensor ORDER BY seq ROWS UNBOUNDED PRECEDING)",
    ),
    "checkpoint_windows": (lambda s, d: _checkpoint_columns(S.checkpoints(_readings(s, d))), f"{WITH}, {CHECKPOINTS} SELECT * FROM cpv"),
    "window_stats": (
        _over(S.window_stats),
        f"{WITH} SELECT sensor, seq, min(t10) OVER w AS min_t10, max(t10) OVER w AS max_t10, sum(t10) OVER w / 10.0 / count(*) OVER w AS avg_temp FROM readings WINDOW w AS (PARTITION BY sensor ORDER BY minute RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)",
    ),
    "recent_trend": (
        _over(S.recent_trend),
        f"""{WITH}, s AS (SELECT sensor, seq, CASE WHEN count(*) OVER {LAST} < 2 THEN 0.0 ELSE round(regr_slope(t10 / 10.0, seq) OVER {LAST}, 6) + 0.0 END AS slope FROM readings)
        SELECT sensor, seq, slope, CASE WHEN slope > 0.15 THEN 'rising' WHEN slope < -0.15 THEN 'falling' ELSE 'stable' END AS trend FROM s""",
    ),
    "velocity_prev": (
        _over(S.velocity),
        f"""{WITH}, v AS (SELECT sensor, seq, t10, coalesce(t10 - lag(t10) OVER (PARTITION BY sensor ORDER BY seq), 0) AS velocity_t10 FROM readings)
        SELECT *, CASE WHEN velocity_t10 > 20 AND t10 >= 250 THEN 'rapid rise near fault' WHEN velocity_t10 < -20 AND t10 <= 80 THEN 'rapid drop near dropout' WHEN velocity_t10 > 20 THEN 'rapid rise'
        WHEN velocity_t10 < -20 THEN 'rapid drop' WHEN velocity_t10 > 10 THEN 'fast rise' WHEN velocity_t10 < -10 THEN 'fast fall' ELSE '' END AS urgency FROM v""",
    ),
    "last10_temps": (_over(S.last_values), f"{WITH} SELECT sensor, seq, array_to_string(list(t10) OVER {LAST}, ',') AS last_t10 FROM readings"),
    "window_anomalies": (
        _over(S.recent_anomalies),
        f"{WITH} SELECT sensor, seq, CAST(sum({ANOM}) OVER (PARTITION BY sensor ORDER BY minute RANGE BETWEEN 20 PRECEDING AND CURRENT ROW) AS BIGINT) AS anomalies FROM readings",
    ),
    "anomaly_types": (
        anomaly_types,
        f"{WITH} SELECT sensor, CASE WHEN t10 > 320 THEN 'spike_high' WHEN t10 > 280 THEN 'spike_moderate' WHEN t10 < 20 THEN 'dropout_severe' ELSE 'dropout' END AS kind, count(*) AS n FROM readings WHERE t10 > 280 OR t10 < 50 GROUP BY 1, 2",
    ),
    "anomaly_cardinality_exact": (
        anomaly_cardinality,
        f"{WITH} SELECT sensor, count(DISTINCT minute) AS minutes, count(DISTINCT CASE WHEN t10 > 320 THEN 1 WHEN t10 > 280 THEN 2 WHEN t10 < 20 THEN 3 ELSE 4 END) AS kinds FROM readings WHERE t10 > 280 OR t10 < 50 GROUP BY 1",
    ),
    "anomaly_cardinality_hll": (anomaly_cardinality_hll, f"{WITH} SELECT sensor, count(DISTINCT minute) AS minutes, TRUE AS close FROM readings WHERE t10 > 280 OR t10 < 50 GROUP BY 1"),
    "hll_union": (hll_union, f"{WITH} SELECT status, count(DISTINCT minute) AS minutes, TRUE AS close FROM readings GROUP BY 1"),
    "status_counts": (lambda s, d: _readings(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"{WITH} SELECT status, count(*) AS n FROM readings GROUP BY 1"),
    "physical_state": (
        physical_states,
        f"{WITH}, {CHECKPOINTS} SELECT CASE WHEN max_t10 > 280 THEN 'FAULT_HIGH' WHEN min_t10 < 50 THEN 'FAULT_LOW' WHEN max_t10 > 260 THEN 'ELEVATED' WHEN min_t10 < 80 THEN 'COOL' ELSE 'NORMAL' END AS state, count(*) AS n FROM cpv GROUP BY 1",
    ),
    "context_block": (
        context_block,
        f"{WITH} SELECT sensor, count(*) AS n, arg_max(t10, seq) AS latest_t10, sum(t10) / 10.0 / count(*) AS avg_temp, max(CASE WHEN {ANOM} = 1 THEN minute END) AS last_anomaly, count(*) FILTER (WHERE status <> 'OK') AS not_ok FROM readings GROUP BY 1",
    ),
    "precursor_windows": (_over(S.precursor_windows), f"{WITH}, {PRE} SELECT * FROM pre"),
    "precursor_match": (precursor_knn, f"{WITH}, {CHECKPOINTS}, {FEATURES} SELECT sensor, cp, precursor_pct FROM nn"),
    "encode_window_vectors": (
        lambda s, d: S.encode_windows(S.checkpoints(_readings(s, d))),
        f"{WITH}, {CHECKPOINTS} SELECT sensor, cp, round(least(greatest((max_t10 / 10.0 - 20.0) / 20.0, -1.0), 1.0), 6) AS v0, round(least(greatest((CAST(sum_t10 AS DOUBLE) / n / 10.0 - 20.0) / 20.0, -1.0), 1.0), 6) AS v1, CAST(max_t10 > 280 AS INTEGER) AS v2, CAST(min_t10 < 50 AS INTEGER) AS v3 FROM cpv",
    ),
    "encode_reading_vectors": (
        _over(S.encode_readings),
        f"{WITH} SELECT sensor, seq, round(least(greatest((t10 / 10.0 - 20.0) / 20.0, -1.0), 1.0), 6) AS v0, round(sin(minute * (2.0 * pi()) / 200.0), 6) + 0.0 AS v1, round(cos(minute * (2.0 * pi()) / 200.0), 6) + 0.0 AS v2, CAST({ANOM} AS INTEGER) AS v3 FROM readings",
    ),
    "scale_replicate": (
        replicate,
        f"{WITH}, span AS (SELECT max(minute) + 1 AS s FROM readings) SELECT sensor, CAST(c AS INTEGER) AS cycle, count(*) AS n, min(minute + c * s) AS first, max(minute + c * s) AS last FROM readings, range(3) t(c), span GROUP BY 1, 2",
    ),
    "tfi_features": (tfi_features, f"{WITH}, {CHECKPOINTS}, {FEATURES} SELECT sensor, cp, faults, recent, no_data, out_of_range, reported, interval_ratio, base_rate, precursor_pct FROM feats"),
    "tfi_score_ungated": (signal_flags, f"{ALL} SELECT sensor, cp, probability, predicted, concat_ws(',', {SIGNAL_SQL}) AS fired FROM scored"),
    "tfi_score_gated": (tfi_gated, GATED),
    "tfi_posterior": (
        tfi_posterior,
        f"""{ALL}, {TRUTH}, hit AS (SELECT unnest(list_filter([{SIGNAL_SQL}], lambda x: x IS NOT NULL)) AS signal, truth FROM pred)
        SELECT signal, count(*) AS fires, CAST(sum(truth) AS BIGINT) AS hits, CAST(count(*) - sum(truth) AS BIGINT) AS misses, round((sum(truth) + 2.0) / (count(*) + 5.0), 3) AS confidence FROM hit GROUP BY 1""",
    ),
    "threshold_sweep": (sweep, f"{ALL}, {TRUTH}, {SWEEP} SELECT * FROM rates"),
    "roc_auc": (
        roc_auc,
        f"""{ALL}, {TRUTH}, {SWEEP}, pts AS (SELECT fpr, recall FROM rates UNION ALL SELECT 0.0, 0.0 UNION ALL SELECT 1.0, 1.0),
        st AS (SELECT fpr, recall, lag(fpr) OVER w AS x0, lag(recall) OVER w AS y0 FROM pts WINDOW w AS (ORDER BY fpr, recall)) SELECT round(sum((fpr - x0) * (recall + y0) / 2), 6) AS auc FROM st""",
    ),
    "detection_metrics": (
        detection_metrics,
        f"""{ALL}, {TRUTH}, m AS (SELECT count(*) FILTER (WHERE (predicted OR probability >= 0.5) AND truth = 1) AS tp, count(*) FILTER (WHERE (predicted OR probability >= 0.5) AND truth = 0) AS fp, count(*) FILTER (WHERE truth = 1) AS pos, count(*) AS n FROM pred)
        SELECT *, round(CAST(tp AS DOUBLE) / greatest(pos, 1), 6) AS recall, round(CAST(fp AS DOUBLE) / greatest(n - pos, 1), 6) AS fpr FROM m""",
    ),
    "percentile_floor_n": (
        percentiles(True),
        f"{WITH}, l AS (SELECT sensor, list_sort(list(t10)) AS v FROM readings GROUP BY 1) SELECT sensor, CAST(p AS DOUBLE) AS p, v[CAST(least(floor(len(v) * CAST(p AS DOUBLE)), len(v) - 1) AS BIGINT) + 1] AS t10 FROM l, (VALUES (0.5), (0.95), (0.99)) t(p)",
    ),
    "percentile_floor_n1": (
        percentiles(False),
        f"{WITH}, l AS (SELECT sensor, list_sort(list(t10)) AS v FROM readings GROUP BY 1) SELECT sensor, CAST(p AS DOUBLE) AS p, v[CAST(floor((len(v) - 1) * CAST(p AS DOUBLE)) AS BIGINT) + 1] AS t10 FROM l, (VALUES (0.5), (0.95), (0.99)) t(p)",
    ),
    "percentile_linear": (percentile_linear, f"{WITH} SELECT sensor, round(quantile_cont(CAST(t10 AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(t10 AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST(t10 AS DOUBLE), 0.99), 6) AS p99 FROM readings GROUP BY 1"),
    "mean_std": (
        mean_std,
        f"{WITH}, a AS (SELECT sensor, count(*) AS n, CAST(sum(t10) AS BIGINT) AS s, CAST(sum(t10 * t10) AS BIGINT) AS q FROM readings GROUP BY 1), b AS (SELECT *, CASE WHEN n < 2 THEN 0.0 ELSE CAST(n * q - s * s AS DOUBLE) / (n * (n - 1)) END AS v FROM a) SELECT sensor, round(CAST(s AS DOUBLE) / n, 6) AS mean, round(sqrt(v), 6) AS std, round(sqrt(v / n), 6) AS stderr FROM b",
    ),
    "bootstrap_mean_ci": (bootstrap_mean_ci, f"""{WITH}, {DRAWN.format(rows="SELECT status, sensor || ':' || seq AS row_id, CAST(t10 AS DOUBLE) AS x FROM readings")},
        m AS (SELECT status, round, sum(x * w) / nullif(sum(w), 0) AS m FROM d GROUP BY 1, 2), e AS (SELECT status, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
        SELECT status, round(avg(x), 6) AS mean, count(*) AS n, round(min(low), 6) AS low, round(min(high), 6) AS high FROM rows JOIN e USING (status) GROUP BY 1"""),
    "bootstrap_quantile": (bootstrap_quantile, BOOT_QUANTILE.format(rows="SELECT status, sensor || ':' || seq AS row_id, t10 AS x FROM readings")),
    "bootstrap_cross_run": (bootstrap_cross_run, BOOT_QUANTILE.format(rows="SELECT status, status || ':' || (minute // 1440) AS row_id, quantile_cont(CAST(t10 AS DOUBLE), 0.5) AS x FROM readings GROUP BY status, minute // 1440")),
    "bootstrap_median_ratio": (bootstrap_median_ratio, f"""{WITH}, {CHECKPOINTS}, {DRAWN.format(rows=RATIO_ROWS)}, u AS (SELECT round, a, b, unnest(range(w)) FROM d),
        r AS (SELECT round, quantile_cont(a, 0.5) / nullif(quantile_cont(b, 0.5), 0) AS r FROM u GROUP BY 1 HAVING quantile_cont(b, 0.5) > 0)
        SELECT (SELECT round(quantile_cont(a, 0.5) / greatest(quantile_cont(b, 0.5), 1e-9), 6) FROM rows) AS ratio, (SELECT count(*) FROM rows) AS n, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high,
        quantile_cont(r, 0.025) < 1 AND quantile_cont(r, 0.975) > 1 AS has_one FROM r"""),
    "report_score": (report_text, REPORTS),
    "question_answers": (questions, QUESTIONS),
    "window_at_probe": (window_at_probe, PROBES),
    "encode_precursor_vectors": (encode_precursors, f"{WITH}, {CHECKPOINTS}, {FEATURES.split('fl AS (')[0].rstrip().rstrip(',')}, w AS (SELECT sensor, seq AS fault_seq, {VECTOR_PW} AS v FROM pw) SELECT sensor, fault_seq, round(v[1], 6) + 0.0 AS v0, round(v[2], 6) + 0.0 AS v1, round(v[3], 6) + 0.0 AS v2, v[4] AS v3 FROM w"),
    "context_text": (context_text, CONTEXTS),
    "synthesis_text": (synthesis_text, SYNTHESIS),
    "prediction_context": (prediction_context, PREDICTIONS),
    "tfi_score_old": (tfi_old, f"{ALL} SELECT sensor, cp, probability_old AS probability, s_exp OR s_over OR s_pre OR s_rise OR s_drop AS predicted, concat_ws(',', {SIGNAL_SQL.split(', CASE WHEN s_flick')[0]}) AS fired FROM scored"),
    "tfi_explain": (tfi_explain, EXPLAIN),
    "tfi_reset": (tfi_reset, f"{WITH}, x AS (SELECT sensor, max(seq) AS cut FROM readings WHERE status = 'OK' AND minute < 20000 AND (sensor, minute) IN (SELECT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 FROM events WHERE event_type = 'purchase') GROUP BY 1) SELECT r.sensor, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS faults, min(CASE WHEN hit THEN minute END) AS first_fault, max(CASE WHEN hit THEN minute END) AS last_fault FROM (SELECT r.*, status = 'FAULT' AND seq > coalesce(cut, 0) AS hit FROM readings r LEFT JOIN x USING (sensor)) r GROUP BY 1"),
    "status_parse": (status_parse, "SELECT CASE event_type WHEN 'error' THEN 'FAULT' WHEN 'click' THEN 'CALIB_ERROR' WHEN 'signup' THEN 'NO_DATA' ELSE 'OK' END AS status, count(*) AS n FROM events GROUP BY 1"),
    "sensor_window_tool": (sensor_window_tool, f"{WITH}, {CHECKPOINTS} SELECT sensor, cp, minute, max_t10, min_t10 FROM cpv WHERE has_anomaly = 1 AND minute BETWEEN 10000 AND 30000"),
    "signal_calibration": (
        tfi_posterior,
        f"""{ALL}, {TRUTH}, hit AS (SELECT unnest(list_filter([{SIGNAL_SQL}], lambda x: x IS NOT NULL)) AS signal, truth FROM pred)
        SELECT signal, count(*) AS fires, CAST(sum(truth) AS BIGINT) AS hits, CAST(count(*) - sum(truth) AS BIGINT) AS misses, round((sum(truth) + 2.0) / (count(*) + 5.0), 3) AS confidence FROM hit GROUP BY 1""",
    ),
    "bootstrap_paired_ratio": (bootstrap_paired_ratio, f"""{WITH}, {CHECKPOINTS}, {DRAWN.format(rows=RATIO_ROWS + " WHERE min_t10 <> 0")}, r AS (SELECT round, sum(a * w) / nullif(sum(b * w), 0) AS r FROM d GROUP BY 1)
        SELECT (SELECT round(sum(a) / sum(b), 6) FROM rows) AS ratio, (SELECT count(*) FROM rows) AS n, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high,
        quantile_cont(r, 0.025) <= 1 AND quantile_cont(r, 0.975) >= 1 AS has_one FROM r"""),
}
