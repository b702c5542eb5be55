"""Queries over limits that depend on all that a key did before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import limits
from tidemark.plans import analogue as A

ORDERED_SQL = "e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events)"
WINDOW, BUCKET, LOCKOUT = limits.FixedWindow(3, limits.DAY), limits.TokenBucket(2, limits.DAY), limits.Lockout(3, 720, "error", "signup")


def limited(spark: SparkSession, sf_dir: str, rule) -> DataFrame:
    events = A.read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return limits.limited(events, rule, key="user_id", at="ts", kind="event_type", tie="event_id")


@query(
    f"""WITH RECURSIVE {ORDERED_SQL}, w AS (SELECT event_id, user_id, n, ms AS opened, 1 AS nth FROM e WHERE n = 1
      UNION ALL SELECT e.event_id, e.user_id, e.n, CASE WHEN e.ms >= opened + {limits.DAY} THEN e.ms ELSE opened END, CASE WHEN e.ms >= opened + {limits.DAY} THEN 1 ELSE nth + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT event_id, user_id::VARCHAR AS key, nth, nth <= 3 AS allowed FROM w"""
)
def window_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three events of a user in a window of a day that opens with an event."""
    return limited(spark, sf_dir, WINDOW)


@query(
    f"""WITH RECURSIVE {ORDERED_SQL}, r AS (SELECT 2 / {limits.DAY}::DOUBLE AS rate), b AS (SELECT event_id, user_id, n, ms, 2::DOUBLE AS had FROM e WHERE n = 1
      UNION ALL SELECT e.event_id, e.user_id, e.n, e.ms, least(2::DOUBLE, CASE WHEN had >= 1 THEN had - 1 ELSE had END + (e.ms - b.ms) * rate) FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1, r)
    SELECT event_id, user_id::VARCHAR AS key, CASE WHEN had >= 1 THEN 0 ELSE ceil((1 - had) / rate)::BIGINT END AS delay_ms, had >= 1 AS allowed FROM b, r"""
)
def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokens a user, refilled evenly within a day."""
    return limited(spark, sf_dir, BUCKET)


@query(
    f"""WITH RECURSIVE {ORDERED_SQL}, l AS (SELECT event_id, user_id, n, (event_type = 'error')::INTEGER AS failures, NULL::BIGINT AS locked, false AS refused FROM e WHERE n = 1
      UNION ALL SELECT event_id, user_id, n, CASE WHEN refused THEN f WHEN event_type = 'signup' THEN 0 WHEN event_type = 'error' THEN f + 1 ELSE f END,
        CASE WHEN refused THEN u WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' AND (f + 1) % 3 = 0 THEN ms + least(720 * 2 ** ((f + 1) // 3 - 1), 1440)::BIGINT * 60000 ELSE u END, refused
      FROM (SELECT e.*, CASE WHEN e.ms - locked >= {limits.DAY} THEN 0 ELSE failures END AS f, CASE WHEN e.ms - locked >= {limits.DAY} THEN NULL ELSE locked END AS u, coalesce(e.ms < locked, false) AS refused FROM l JOIN e ON e.user_id = l.user_id AND e.n = l.n + 1))
    SELECT event_id, user_id::VARCHAR AS key, failures, locked AS locked_until_ms, refused FROM l"""
)
def lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three errors in a row lock a user for twelve hours, then a day; a signup, or a day after a lock, begins anew."""
    return limited(spark, sf_dir, LOCKOUT)
