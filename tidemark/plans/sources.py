"""Payloads of platforms, logs, reviews and answers: rows written the way that each source writes them, read back as items."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import answers
from ..operators import feeds
from ..sources import payloads
from ..streaming import jobs
from .registry import query, read


def _payload(df, **fields):
    return df.select(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("payload"))


@query("""
SELECT 'reddit_' || event_id AS item_id, 'r/' || event_type AS source, 'https://www.reddit.com/c/' || event_id AS url, value AS score, user_id::DOUBLE AS comments, date_trunc('second', ts) AS published_at FROM events""")
def items_reddit(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    made = _payload(e, id=F.col("event_id").cast("string"), title=F.col("event_type"), subreddit=F.col("event_type"), permalink=F.concat(F.lit("/c/"), "event_id"), score=F.col("value"),
                    num_comments=F.col("user_id"), created_utc=F.unix_seconds(F.col("ts").cast("timestamp")), is_self=F.lit(True), selftext=F.lit("x"))
    m = lambda k: F.element_at("metrics", F.lit(k)).alias(k)
    return payloads.reddit(made).select("item_id", "source", "url", m("score"), m("comments"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("""
SELECT 'gh_' || lower(p_brand || '/' || p_name) AS item_id, arg_min(p_retailprice, (p_partkey % 3, p_partkey)) AS stars, count(*) AS named FROM part GROUP BY 1""")
def items_github(spark, sf_dir):
    """Repositories named in several files, and in several cases: the first file wins."""
    part = read(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")), F.lit("/"), "p_name")
    made = part.select(F.to_json(F.struct(name.alias("full_name"), F.col("p_retailprice").alias("stars"))).alias("payload"), (F.col("p_partkey") % 3 * 1_000_000 + F.col("p_partkey")).alias("priority"))
    named = part.groupBy(F.lower(F.concat_ws("/", "p_brand", "p_name")).alias("name")).agg(F.count("*").alias("named"))
    items = payloads.github(made).select("item_id", F.element_at("metrics", F.lit("stars")).alias("stars"))
    return items.join(named, F.col("item_id") == F.concat(F.lit("gh_"), "name")).select("item_id", "stars", "named")


@query("""
SELECT 'rss_' || substr(md5(o_orderkey || '-' || l_linenumber), 1, 12) AS item_id, o_orderpriority AS source, 'http://x/' || o_orderkey || '/' || l_linenumber AS url, l_returnflag AS author
FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey""")
def items_rss(spark, sf_dir):
    """Feeds with several entries each."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("author"))
    key = lambda sep: F.concat_ws(sep, F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    entry = F.struct(key("-").alias("id"), F.concat(F.lit("http://x/"), key("/")).alias("link"), F.lit("t").alias("title"), "author")
    feeds_ = lines.groupBy("l_orderkey").agg(F.collect_list(entry).alias("items")).join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    made = _payload(feeds_, feed_title=F.col("o_orderpriority"), items=F.col("items"))
    return payloads.rss(made).select("item_id", "source", "url", "author")


@query("""
SELECT CAST(event_id AS VARCHAR) AS item_id, 'u' || user_id AS source, CASE WHEN event_type = 'view' THEN 'long read' ELSE substr(props, 1, 80) END AS title, value AS likes FROM events""")
def items_twitter(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    made = _payload(e, id=F.col("event_id").cast("string"), text=F.col("props"), articleTitle=F.when(F.col("event_type") == "view", "long read"),
                    author=F.struct(F.lit("n").alias("name"), F.concat(F.lit("u"), "user_id").alias("screenName")), metrics=F.struct(F.col("value").alias("likes")))
    return payloads.twitter(made).select("item_id", "source", "title", F.element_at("metrics", F.lit("likes")).alias("likes"))


@query("""
SELECT 'BV' || p_partkey AS item_id, p_name AS title, 'https://www.bilibili.com/video/BV' || p_partkey AS url, p_size::DOUBLE AS views FROM part""")
def items_bilibili(spark, sf_dir):
    """Lists of videos under any of the keys that they come under, or alone."""
    part = read(spark, sf_dir, "part")
    video = F.struct(F.concat(F.lit("BV"), "p_partkey").alias("bvid"), F.concat(F.lit("<em>"), "p_name", F.lit("</em>")).alias("title"), F.struct(F.col("p_size").cast("double").alias("view")).alias("stats"))
    lists = part.groupBy("p_brand", (F.col("p_partkey") % 3).alias("kind")).agg(F.collect_list(video).alias("v"))
    made = lists.select(F.when(F.col("kind") == 0, F.to_json(F.struct(F.struct(F.col("v").alias("list")).alias("data")))).when(F.col("kind") == 1, F.to_json(F.struct(F.col("v").alias("items")))).otherwise(F.to_json("v")).alias("payload"))
    return payloads.bilibili(made).select("item_id", "title", "url", F.element_at("metrics", F.lit("views")).alias("views"))


@query("""
SELECT 'n' || c_custkey AS item_id, c_name AS title, CASE c_custkey % 3 WHEN 0 THEN 12000.0 WHEN 1 THEN 35.0 ELSE 7.0 END AS likes FROM customer""")
def items_xiaohongshu(spark, sf_dir):
    """Notes under any of three keys, with counts as people write them."""
    c, kind = read(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    note = F.struct(F.col("c_name").alias("title"), F.struct(F.when(kind == 0, "1.2万").when(kind == 1, "35").otherwise("7").alias("liked_count")).alias("interact_info"))
    made = c.select(F.to_json(F.struct(F.concat(F.lit("n"), "c_custkey").alias("id"), F.when(kind == 0, note).alias("detail"), F.when(kind == 1, note).alias("note_card"), F.when(kind == 2, note).alias("feed_card"))).alias("payload"))
    return payloads.xiaohongshu(made).select("item_id", "title", F.element_at("metrics", F.lit("likes")).alias("likes"))


@query("""
SELECT 'e' || s_suppkey AS item_id, n_name AS source, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'w' ELSE 's' END || s_suppkey AS url FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def items_lingowhale(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    made = _payload(s, entry_id=F.concat(F.lit("e"), "s_suppkey"), title=F.concat(F.lit("<hl>"), "s_name", F.lit("</hl>")), channel=F.struct(F.col("n_name").alias("name")),
                    surface_url=F.concat(F.lit("s"), "s_suppkey"), wechat_url=F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("w"), "s_suppkey")))
    return payloads.lingowhale(made).select("item_id", "source", "title", "url")


@query("""
SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 4 > 0 THEN 'says "' || p_type || '",' || chr(10) || 'twice' END AS note, p_retailprice AS score FROM part""")
def review_roundtrip(spark, sf_dir):
    """Reviews written as CSV and read again, quotes, commas and line breaks included."""
    note = F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit('says "'), "p_type", F.lit('",\ntwice')))
    path = f"{jobs.shared_dir(spark)}/reviews-{uuid.uuid4().hex}"
    payloads.write_reviews(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), note.alias("note"), F.col("p_retailprice").alias("score")), path)
    return payloads.read_reviews(spark, path, "id long, title string, note string, score double")


@query("""
SELECT event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type IN ('click', 'error') GROUP BY 1""")
def event_log(spark, sf_dir):
    """Two appends to a log of JSON lines and one of broken lines, read back with these skipped."""
    path, e = f"{jobs.shared_dir(spark)}/log-{uuid.uuid4().hex}", read(spark, sf_dir, "events")
    for kind in ("click", "error"):
        payloads.append_log(e.where(F.col("event_type") == kind).select(F.col("event_type").alias("kind"), "value", F.col("event_id").alias("id")), path)
    spark.createDataFrame([('{"kind": "click", "value": 1.0, "id"',), ("no json",), ('{"kind": "error", "value": "many", "id": 1}',), ("[1, 2",)], "line string").write.mode("append").text(path)
    return payloads.json_lines(spark, path, "kind string, value double, id long").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_type IN ('PROMO', 'SMALL', 'LARGE') THEN lower(p_type) ELSE 'other' END AS kind, CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 7 > 0 THEN least(greatest(p_size - 5.0, 0), 30) END AS score,
  CASE WHEN p_partkey % 5 = 4 THEN '' WHEN p_type = 'PROMO' THEN 'promo,small' ELSE 'small' END AS tags FROM part""")
def parsed_answers(spark, sf_dir):
    """Answers with JSON alone, in fences, in talk, or broken: words of fixed lists, numbers in bounds, lists cut."""
    part, key = read(spark, sf_dir, "part"), F.col("p_partkey")
    body = F.to_json(F.struct(F.concat(F.lit(" "), "p_type").alias("kind"), F.when(key % 7 == 0, "n/a").otherwise((F.col("p_size") - 5).cast("string")).alias("score"), F.array("p_type", F.lit("Small"), F.lit("nonsense"), F.lit("small")).alias("tags")))
    said = F.when(key % 5 == 0, body).when(key % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(key % 5 == 4, F.concat(body, F.lit(" }"))).otherwise(F.concat(F.lit("Sure! "), body, F.lit(" Done.")))
    a = part.select(key.alias("id"), answers.parsed(said, "kind string, score string, tags array<string>").alias("a"), answers.json_text(said).alias("raw"))
    fine = ~F.col("raw").endswith("} }")
    kind = F.when(fine, answers.one_of(F.col("a.kind"), ["promo", "small", "large"], "other"))
    tags = answers.some_of(F.when(fine, F.col("a.tags")), ["promo", "small"], 2)
    return a.select("id", kind.alias("kind"), F.when(fine, answers.bounded(F.col("a.score"), 0, 30)).alias("score"), F.array_join(tags, ",").alias("tags"))


@query("""
WITH i AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'manual' WHEN 2 THEN 'twitter' ELSE lang END AS platform, CASE doc_id % 11 WHEN 0 THEN 'search:x' WHEN 1 THEN 'bookmarks' ELSE source END AS source,
    n_chars % 100 AS stars, doc_id % 3 AS owner, CASE doc_id % 6 WHEN 0 THEN 'other' WHEN 1 THEN 'ai_tools/x' WHEN 2 THEN 'coding' WHEN 3 THEN NULL ELSE 'models' END AS category, text, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 700) AS at_ FROM documents),
s AS (SELECT json_extract(props, '$.k')::BIGINT AS doc_id, max(ts) AS read_at FROM events WHERE user_id % 10 = 1 GROUP BY 1)
SELECT i.doc_id, platform, at_ AS fetched_at, s.read_at FROM i LEFT JOIN s USING (doc_id)
WHERE NOT starts_with(source, 'search:') AND NOT (platform = 'twitter' AND source = 'bookmarks') AND (platform <> 'github' OR stars >= 50) AND (platform <> 'manual' OR owner = 1) AND category IS NOT NULL AND category <> 'other'
  AND at_ >= TIMESTAMP '2024-01-03' AND at_ < TIMESTAMP '2024-01-28' AND (contains(lower(text), 'the') OR contains(lower(source), 'src1')) ORDER BY at_ DESC, i.doc_id LIMIT 60 OFFSET 10""")
def feed_query(spark, sf_dir):
    """The whole feed: display, owner's and relevance rules, category, words, window, the reader's status, one page."""
    key = F.col("doc_id")
    items = read(spark, sf_dir, "documents").select(
        "doc_id", F.when(key % 5 == 0, "github").when(key % 5 == 1, "manual").when(key % 5 == 2, "twitter").otherwise(F.col("lang")).alias("platform"),
        F.when(key % 11 == 0, "search:x").when(key % 11 == 1, "bookmarks").otherwise(F.col("source")).alias("source"), (F.col("n_chars") % 100).alias("stars"), (key % 3).cast("string").alias("owner"),
        F.when(key % 6 == 0, "other").when(key % 6 == 1, "ai_tools/x").when(key % 6 == 2, "coding").when(key % 6 > 3, "models").alias("category"), "text",
        (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), (key % 700).cast("int"))).alias("fetched_at"))
    status = read(spark, sf_dir, "events").where("user_id % 10 = 1").groupBy(F.get_json_object("props", "$.k").cast("long").alias("doc_id")).agg(F.max("ts").alias("read_at"))
    shown = items.where(
        feeds.visible_display(F.col("source"), F.col("platform"), F.col("stars")) & feeds.visible_manual(F.col("platform"), F.col("owner"), "1") & feeds.relevant(feeds.canonical_category(F.col("category")), F.lit(None).cast("array<string>"))
        & feeds.in_window(F.col("fetched_at"), "2024-01-03 00:00:00", "2024-01-28 00:00:00") & (feeds.searched("the", "text") | feeds.searched("src1", "source")))
    return feeds.page(shown.join(status, "doc_id", "left").select("doc_id", "platform", "fetched_at", "read_at"), [F.desc("fetched_at"), F.col("doc_id")], 60, 10)
