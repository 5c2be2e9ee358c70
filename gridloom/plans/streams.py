"""Batch forms of the streaming operators over the event table: what the streams give once all is in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.folds import r
from gridloom.plans.registry import Views, query
from gridloom.sources import tables
from gridloom.streaming import partials, streams


@query("t5_hourly_fold", "SELECT date_trunc('hour', ts) AS t, user_id % 16 AS key, round(avg(value), 9) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return streams.hourly_fold(v.events, F.col("user_id") % 16, "value").withColumn("value", r("value"))


@query("t6_daily_rollup", "SELECT date_trunc('day', ts) AS day, user_id % 16 AS key, round(avg(value), 9) AS mean, round(max(value), 9) AS most FROM events GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return streams.daily_rollup(v.events, F.col("user_id") % 16, "value").select("day", "key", r("mean").alias("mean"), r("most").alias("most"))


@query("t6_sliding_film", "SELECT date_trunc('day', ts) - to_days(CAST(k AS INT)) AS start, user_id % 16 AS key, round(avg(value), 9) AS mean FROM events, range(3) s(k) GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return streams.sliding_film(v.events, F.col("user_id") % 16, "value", 3).withColumn("mean", r("mean", 9))


@query("t8_hot_sessions", "WITH h AS (SELECT user_id % 16 AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id % 16 ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'error'), n AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM h) SELECT key, min(ts) AS first, max(ts) + INTERVAL 30 MINUTE AS last, count(*) AS n FROM n GROUP BY key, run")
def _(v: Views) -> DataFrame:
    return streams.hot_sessions(v.events, F.col("user_id") % 16, F.col("event_type") == "error", "30 minutes")


@query("t5_a9_a10_merged_batches", "SELECT date_trunc('hour', ts) AS t, user_id % 16 AS key, round(avg(value), 9) AS value, count(value) AS n, round(min(value), 9) AS mn, round(max(value), 9) AS mx FROM events GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    """All events in four batches that lie across each other in time; one is replayed before and one after a new base."""
    path, key = tables.new_path(v.spark), F.col("user_id") % 16
    batch = lambda k: partials.merge_batch(v.events.where(F.pmod("event_id", F.lit(4)) == k), k, path, key, "value")
    for k in (0, 1, 1):
        batch(k)
    partials.compact(v.spark, path)
    for k in (0, 2, 3):
        batch(k)
    return partials.merged_hours(v.spark, path).select("t", "key", r("value").alias("value"), "n", r("mn").alias("mn"), r("mx").alias("mx"))


@query("t6_merged_days", "SELECT date_trunc('day', ts) AS day, user_id % 16 AS key, round(avg(value), 9) AS mean, round(max(value), 9) AS most FROM events GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    path = tables.new_path(v.spark)
    for k in range(3):
        partials.merge_batch(v.events.where(F.pmod("event_id", F.lit(3)) == k), k, path, F.col("user_id") % 16, "value")
    return partials.merged_days(v.spark, path).select("day", "key", r("mean").alias("mean"), r("most").alias("most"))
