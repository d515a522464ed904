"""Streaming queries, run to the end of what is there, and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sensor as S
from ..sources import files
from ..sources.shared import shared_dir
from ..streaming import sensor as stream
from .common import table
from .sensor import ANOM, GATED, WITH, scored_readings


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, d):
    """The event files of a folder, as a stream; a table may be one file or a folder of files."""
    return stream.read_events(spark, d, pathGlobFilter="events.parquet")


def stream_running_stats(spark, d):
    return stream.drain(stream.running_stats(_events(spark, d)), "complete", _folder(spark))


def stream_windows(spark, d):
    """All closed windows: those that end after the watermark, an hour before the newest event, aren't out yet."""
    out = stream.drain(stream.windows(_events(spark, d), "1 day"), "append", _folder(spark))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "sum_t10", "max_t10")


def stream_session(spark, d):
    out = stream.drain(stream.sessions(_events(spark, d)), "append", _folder(spark))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_newest(spark, d):
    return stream.drain(stream.newest(_events(spark, d), 5), "update", _folder(spark))


def stream_gated(spark, d):
    """Scored checkpoints written as files, and the gate over them as a stream: one batch holds them all."""
    r = S.readings(table(spark, d, "events"))
    scored = scored_readings(r).select("sensor", "cp", "fired", "has_anomaly")
    path = _folder(spark)
    scored.write.parquet(path)
    live = spark.readStream.schema(scored.schema).parquet(path)
    return stream.drain(stream.gated_scores(live), "update", _folder(spark))


def snapshot_roundtrip(spark, d):
    """The hash of statistics per sensor, saved, loaded and read."""
    stats = S.session_stats(S.readings(table(spark, d, "events")))
    path = _folder(spark)
    files.save_snapshot({"stats": stats}, path, 1)
    return files.load_snapshot(spark, path, 1, ["stats"])["stats"]


QUERIES = {
    "stream_running_stats": (stream_running_stats, f"{WITH} SELECT sensor AS user_id, count(*) AS n, CAST(sum(t10) AS BIGINT) AS sum_t10, min(t10) AS min_t10, max(t10) AS max_t10 FROM readings GROUP BY 1"),
    "stream_windows": (
        stream_windows,
        f"{WITH}, w AS (SELECT user_id, date_trunc('day', ts) AS d, count(*) AS n, CAST(sum((CAST(round(value * 100) AS BIGINT) % 4000) // 10) AS BIGINT) AS sum_t10, max((CAST(round(value * 100) AS BIGINT) % 4000) // 10) AS max_t10 FROM events GROUP BY 1, 2) SELECT user_id, strftime(d, '%Y-%m-%d') AS day, n, sum_t10, max_t10 FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    ),
    "stream_session": (
        stream_session,
        """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    ),
    "stream_newest": (stream_newest, "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i <= 5"),
    "stream_gated": (stream_gated, GATED),
    "snapshot_roundtrip": (
        snapshot_roundtrip,
        f"{WITH} SELECT sensor, count(*) AS n, CAST(sum(t10) AS BIGINT) AS sum_t10, min(t10) AS min_t10, max(t10) AS max_t10, CAST(sum({ANOM}) AS BIGINT) AS anomalies, arg_max(t10, seq) AS latest_t10, sum(t10) / 10.0 / count(*) AS avg_temp FROM readings GROUP BY sensor",
    ),
}
