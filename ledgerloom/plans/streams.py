"""Streams over the events, run to their present end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.base import query
from ledgerloom.streaming import scans


def events(spark: SparkSession, sf: str) -> DataFrame:
    return scans.stream_of(spark, sf, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scans.latest_batch(scans.run_to_end(scans.window_counts(events(spark, sf), "ts", "event_type", "1 day", "2 hours"), "complete"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return scans.run_to_end(scans.first_seen(events(spark, sf), ["user_id", "event_type"], "ts", "60 days")).select("user_id", "event_type")


#: A user that isn't seen for two days is absent.
SILENCE_MS = 2 * 24 * 3600 * 1000


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS t, event_type AS f FROM events), x AS (SELECT *, lag(t) OVER w AS was, lag(f) OVER w AS before, lead(t) OVER w AS next, max(t) OVER () AS fin FROM e WINDOW w AS (PARTITION BY key ORDER BY t, f))
SELECT key, 'NEW' AS event, t AS at_ms FROM x WHERE was IS NULL UNION ALL SELECT key, 'REAPPEARED', t FROM x WHERE t > was + {SILENCE_MS} UNION ALL SELECT key, 'CHANGED', t FROM x WHERE was IS NOT NULL AND f <> before UNION ALL SELECT key, 'NO_LONGER_OBSERVED', t + {SILENCE_MS} FROM x WHERE coalesce(next, fin) > t + {SILENCE_MS}""")
def stream_presence(spark: SparkSession, sf: str) -> DataFrame:
    """When users appear, change what they do, fall silent and come back, by keyed state and timers."""
    scans.with_keyed_state(spark)
    return scans.run_to_end(scans.presence_events(events(spark, sf), "user_id", "ts", "event_type", SILENCE_MS)).select("key", "event", "at_ms")
