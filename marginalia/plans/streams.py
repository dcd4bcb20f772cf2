"""Window queries over the event table; the same plans run as streams (see tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.plans.catalog import query
from marginalia.sources.tables import table
from marginalia.streaming import windows as S


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def tumbling_hours(spark, sf):
    return S.flat(S.windowed(table(spark, sf, "events"), F.window("ts", "1 hour"), "event_type"))


@query("""
    WITH s AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start, value FROM events)
    SELECT start, start + INTERVAL 2 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1""")
def sliding_hours(spark, sf):
    return S.flat(S.windowed(table(spark, sf, "events"), F.window("ts", "2 hours", "1 hour")))


@query("""
    WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS fresh FROM events),
    i AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, k""")
def sessions(spark, sf):
    return S.flat(S.windowed(table(spark, sf, "events"), F.session_window("ts", "30 minutes"), "user_id"))
