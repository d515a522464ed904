"""Streams of sensor events: running statistics, windows, sessions, newest entries, fault scores with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import faults

#: Fixed value: columns of the event log.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, **options) -> DataFrame:
    """Event files as a stream; event time must be a timestamp with a zone for watermarks, here UTC's."""
    raw = spark.readStream.schema(EVENTS).options(**options).parquet(path)
    return raw.withColumn("ts", F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")))).withColumn("t10", F.expr("(cast(round(value * 100) as bigint) % 4000) div 10"))


def running_stats(events: DataFrame) -> DataFrame:
    """Per sensor over all time; complete or update output."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("t10").alias("sum_t10"), F.min("t10").alias("min_t10"), F.max("t10").alias("max_t10"))


def windows(events: DataFrame, width: str = "20 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding windows; rows later than ``late`` are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("t10").alias("sum_t10"), F.max("t10").alias("max_t10"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "sum_t10", "max_t10")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def newest(events: DataFrame, keep: int) -> DataFrame:
    """MAXLEN as state: each batch gives the changed sensors' last ``keep`` events."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            held += [f"{t.value:020d}:{e}" for t, e in zip(pdf["ts"], pdf["event_id"], strict=True)]
        held = sorted(held)[-keep:]
        state.update((held,))
        yield pd.DataFrame({"user_id": key[0], "event_id": [int(x.rpartition(":")[2]) for x in held]})

    return events.select("user_id", "ts", "event_id").groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint", "held array<string>", "update", GroupStateTimeout.NoTimeout)


def gated_scores(scored: DataFrame) -> DataFrame:
    """The learning gate over a stream of scored checkpoints (sensor, cp, fired, has_anomaly), in the order of cp within a batch."""
    width = len(faults.SIGNALS)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, before = (list(state.get[0]), list(state.get[1])) if state.exists else ([0] * (2 * width), [])
        record = {k: [counts[2 * i], counts[2 * i + 1]] for i, k in enumerate(faults.SIGNALS)}
        rows = pd.concat(list(batches)).sort_values("cp")
        out = []
        for fired, truth in zip(rows["fired"], rows["has_anomaly"], strict=True):
            for k in before:
                record[k][0 if truth else 1] += 1
            out.append(any(k in faults.TRIGGERS and faults.allowed(*record[k]) for k in fired))
            before = list(fired)
        state.update(([x for k in faults.SIGNALS for x in record[k]], before))
        yield pd.DataFrame({"sensor": key[0], "cp": rows["cp"].to_numpy(), "predicted": out})

    return scored.groupBy("sensor").applyInPandasWithState(run, "sensor bigint, cp bigint, predicted boolean", "counts array<int>, before array<string>", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """Runs what is there to its end, each batch written as Parquet below ``path``, and reads it back.

    Complete output is that of the last batch; append and update output that of all batches."""
    out = f"{path}/out"
    write = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    found = stream.sparkSession.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(out)
    if mode == "complete":
        found = found.filter(F.col("batch") == (found.agg(F.max("batch")).first()[0] or 0))
    return found.drop("batch")


def publish(stream: DataFrame, path: str, checkpoint: str):
    """A sink of Parquet files, written once per batch."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
