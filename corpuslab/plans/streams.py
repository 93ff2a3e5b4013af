"""Event-time window queries, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.windows import first_seen, run_to_end, sessions, sliding, state_folder, stream_table, tumbling, with_event_time
from .base import query, table


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df, *columns):
    """Timestamps without a zone, as the fixtures have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("g_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def g_tumbling(spark, d):
    return _plain(tumbling(_events(spark, d), "ts", "1 hour", "event_type"), "start", "end")


@query("g_sliding_windows", "WITH x AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events), y AS (SELECT b AS start FROM x UNION ALL SELECT b - INTERVAL 30 MINUTE FROM x) SELECT start, count(*) AS n FROM y GROUP BY 1")
def g_sliding(spark, d):
    return _plain(sliding(_events(spark, d)), "start")


@query("g_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n FROM y GROUP BY user_id, s""")
def g_sessions(spark, d):
    return _plain(sessions(_events(spark, d), "user_id"), "start", "end")


@query("g4_stream_windows")
def g4(spark, d):
    """Hourly windows by a stream; windows that the watermark has not passed are still open."""
    source = with_event_time(stream_table(spark, d, "events"))
    return run_to_end(tumbling(source, "ts", "1 hour"), state_folder(spark, "stream-windows"))


@query("g6_stream_dedup", "SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def g6(spark, d):
    source = with_event_time(stream_table(spark, d, "events"), "ts", "60 days")
    kept = first_seen(source.select("ts", "user_id", "event_type"), ["user_id", "event_type"])
    return run_to_end(kept, state_folder(spark, "stream-dedup")).select("user_id", "event_type", F.lit(True).alias("seen"))
