"""Pages of a feed while it is published, and what becomes stale."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import feeds
from ..operators.snapshots import Feed
from ..sources.versions import VersionedTables
from ..streaming.jobs import shared_dir
from .registry import query, read


def published_feed(spark, sf_dir):
    """Parts as events of their brand, suppliers' lines of them as dependents; then every third part gets a new title, and every
    sixth one is hidden. Gives the feed and the cursor behind the first page that was read before that."""
    part = read(spark, sf_dir, "part")
    events = part.select(
        F.col("p_partkey").alias("event_id"), F.col("p_brand").alias("category"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("summary"), (F.col("p_partkey") % 10 != 0).alias("visible"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 7919 % 1000 * 3600).alias("last_at"), F.lit(1).cast("long").alias("live_version"))
    line = read(spark, sf_dir, "lineitem")
    dependents = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("dependent_id"), F.col("l_partkey").alias("event_id"),
        F.when(F.col("l_linenumber") == 1, 2).when(F.col("l_linenumber") == 2, None).otherwise(1).cast("long").alias("event_version"), (F.col("l_returnflag") == "R").alias("is_stale"))
    feed = Feed(VersionedTables(spark, f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"))
    feed.begin(events, dependents)
    first, cursor = feed.page("_all", 12)
    key = F.col("p_partkey")
    feed.publish(part.where(key % 3 == 0).select(
        key.alias("event_id"), F.concat(F.lit("New "), "p_name").alias("title"), F.lit(None).cast("string").alias("summary"), F.when(key % 6 == 0, False).when(key % 10 == 0, True).alias("visible")))
    return feed, first, cursor


@query("""
WITH e AS (SELECT p_partkey AS event_id, p_name AS title, p_partkey * 7919 % 1000 AS h, p_partkey % 10 <> 0 AS v1, CASE WHEN p_partkey % 6 = 0 THEN false WHEN p_partkey % 30 = 0 OR p_partkey % 3 = 0 AND p_partkey % 10 = 0 THEN true ELSE p_partkey % 10 <> 0 END AS v2 FROM part),
a AS (SELECT *, row_number() OVER (ORDER BY h DESC, event_id DESC) AS rank FROM e WHERE v1), b AS (SELECT *, row_number() OVER (ORDER BY h DESC, event_id DESC) AS rank FROM e WHERE v2)
SELECT (rank - 1) // 12 + 1 AS page, rank, event_id, title, 1 AS live_version FROM a WHERE rank <= 36
UNION ALL SELECT 0, rank, event_id, CASE WHEN event_id % 3 = 0 THEN 'New ' || title ELSE title END, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END FROM b WHERE rank <= 12""")
def pages_across_publish(spark, sf_dir):
    """Three pages, of which the second and third come after a publish, and the first page of a new sequence (page 0)."""
    feed, first, cursor = published_feed(spark, sf_dir)
    second, cursor = feed.page("_all", 12, cursor)
    third, _ = feed.page("_all", 12, cursor)
    fresh, _ = feed.page("_all", 12)
    out = None
    for number, page in enumerate((fresh, first, second, third)):
        rows = page.select(F.lit(number).cast("long").alias("page"), "rank", "event_id", "title", "live_version")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
SELECT l_partkey AS event_id, count(*) AS dependents, count(*) FILTER (l_returnflag = 'R' OR l_partkey % 3 = 0 AND l_linenumber <> 1) AS stale FROM lineitem GROUP BY l_partkey""")
def stale_dependents(spark, sf_dir):
    """How many of each event's dependents are stale after the publish. A part with lines is an event."""
    feed, _, _ = published_feed(spark, sf_dir)
    return feed.dependents().groupBy("event_id").agg(F.count("*").alias("dependents"), F.count_if("is_stale").alias("stale"))


@query("""
WITH s AS (SELECT json_extract(props, '$.k')::BIGINT AS doc_id, max(ts) FILTER (event_type = 'click') AS clicked_at, max(ts) FILTER (event_type = 'purchase') AS starred_at, max(ts) FILTER (event_type = 'error') AS hidden_at FROM events WHERE user_id = 7 GROUP BY 1),
i AS (SELECT d.doc_id, lang, clicked_at, starred_at, hidden_at FROM documents d LEFT JOIN s USING (doc_id) WHERE contains(lower(text), 'an') OR contains(lower(source || chr(10) || lang), 'an')),
x AS (SELECT 'unread' AS state, *, -doc_id AS o FROM i WHERE clicked_at IS NULL AND hidden_at IS NULL UNION ALL SELECT 'starred', *, -doc_id FROM i WHERE starred_at IS NOT NULL
  UNION ALL SELECT 'clicked', *, -epoch_us(clicked_at) FROM i WHERE clicked_at IS NOT NULL),
r AS (SELECT state, doc_id, row_number() OVER (PARTITION BY state ORDER BY o, doc_id) AS place, count(*) OVER (PARTITION BY state) AS total FROM x)
SELECT state, doc_id, total, total > 30 AS has_more, CASE WHEN total > 30 THEN 30 END::BIGINT AS next_offset FROM r WHERE place > 10 AND place <= 30""")
def feed_states(spark, sf_dir):
    """The second page of one reader's unread, starred and clicked items that hold a keyword, with totals and where to go on."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    events = read(spark, sf_dir, "events").withColumn("doc_id", F.get_json_object("props", "$.k").cast("long"))
    status = events.groupBy("user_id", "doc_id").agg(at("click").alias("clicked_at"), at("purchase").alias("starred_at"), at("error").alias("hidden_at"))
    items = read(spark, sf_dir, "documents").withColumn("keywords", F.array("source", "lang")).where(feeds.holds_any("AN", "text", "keywords")).select("doc_id")
    own = feeds.with_status(items, status, 7, "doc_id")
    newest, last_click = [F.desc("doc_id")], [F.desc("clicked_at"), F.asc("doc_id")]
    out = None
    for state, order in (("unread", newest), ("starred", newest), ("clicked", last_click)):
        rows = feeds.page_of(own.where(feeds.in_state(**{state: True})), order, 20, 10).select(F.lit(state).alias("state"), "doc_id", "total", "has_more", "next_offset")
        out = rows if out is None else out.unionByName(rows)
    return out
