"""Streaming queries and the batch SQL that gives the same rows, and items read from payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import payloads
from ..streaming import jobs
from .registry import query, read


@query("""SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1""")
def stream_dedup(spark, sf_dir):
    return jobs.run_once(jobs.deduplicated(jobs.source(spark, sf_dir, "events"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark, sf_dir):
    return jobs.run_once(jobs.daily_counts(jobs.source(spark, sf_dir, "events")), "update", ["day", "event_type"]).select(F.to_date("day").alias("day"), "event_type", "n", "total")


@query("""SELECT user_id, max(event_id) AS newest, max(ts) AS last_at FROM events GROUP BY 1""")
def stream_newest_per_key(spark, sf_dir):
    return jobs.run_once(jobs.newest_per_key(jobs.source(spark, sf_dir, "events")), "update", ["user_id"]).select("user_id", "newest", F.col("last_at").cast("timestamp_ntz").alias("last_at"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') % 2 = 1 AS starred, max(ts) FILTER (event_type = 'click') AS clicked_at FROM events GROUP BY 1""")
def stream_status_fold(spark, sf_dir):
    return jobs.run_once(jobs.status_fold(jobs.source(spark, sf_dir, "events")), "update", ["user_id"]).select("user_id", "starred", F.col("clicked_at").cast("timestamp_ntz").alias("clicked_at"))


@query("""
WITH marked AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
islands AS (SELECT user_id, place - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM marked WHERE bad),
longest AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) AS n FROM islands GROUP BY ALL) GROUP BY user_id)
SELECT u.user_id, coalesce(longest, 0) AS longest, coalesce(longest, 0) >= 3 AS broken FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN longest USING (user_id)""")
def stream_source_health(spark, sf_dir):
    return jobs.run_once(jobs.source_health(jobs.source(spark, sf_dir, "events")), "update", ["user_id"]).select("user_id", "longest", "broken")


@query("""
SELECT 'hn_' || event_id AS item_id, 'hackernews' AS platform, event_type AS title, value AS score, date_trunc('second', ts) AS published_at FROM events WHERE event_id % 10 = 0""")
def source_items(spark, sf_dir):
    """Events written as payloads of one platform and read back as items."""
    made = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("value").alias("score"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time")))
    items = payloads.hackernews(read(spark, sf_dir, "events").where("event_id % 10 = 0").select(made.alias("payload")))
    return items.select("item_id", "platform", "title", F.element_at("metrics", F.lit("score")).alias("score"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))
