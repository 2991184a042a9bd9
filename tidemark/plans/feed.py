"""Feed queries: documents stand for items, their source for the platform, events for what users did with them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, times
from ..operators import feeds, merges
from .registry import query, read

NOW = "2024-02-01 00:00:00"
#: The item that an event is about, read from its JSON properties.
ITEM = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _item(df):
    return df.withColumn("item_id", F.get_json_object("props", "$.k").cast("long"))


@query("""
SELECT source, doc_id, n_chars, rn FROM (
  SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn
  FROM documents WHERE lang = 'en') WHERE rn <= 3""")
def feed_top_per_source(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where((F.col("lang") == "en") & feeds.visible_display(F.col("source"), F.lit("web")))
    return feeds.top_per_group(docs.select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc_nulls_last(), F.col("doc_id")], 3)


@query("""
SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents WHERE lower(text) LIKE '%tion%' OR lower(source) LIKE '%tion%') AS total
FROM documents WHERE lower(text) LIKE '%tion%' OR lower(source) LIKE '%tion%' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10""")
def feed_search_page(spark, sf_dir):
    hits = read(spark, sf_dir, "documents").where(feeds.searched("TION", "text", "source"))
    found = feeds.page(hits.select("doc_id", "source", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 20, 10)
    return found.join(hits.agg(F.count("*").alias("total")))


@query("""
WITH tagged AS (SELECT doc_id, CASE WHEN lang = 'es' THEN NULL ELSE [lang, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END] END AS cats FROM documents)
SELECT cat, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(cats) AS cat FROM tagged) GROUP BY cat
UNION ALL SELECT '__uncategorized__', count(*) FROM tagged WHERE cats IS NULL""")
def category_counts_exploded(spark, sf_dir):
    size = F.when(F.col("n_chars") > 1500, "long").otherwise("short")
    tagged = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") != "es", F.array("lang", size)).alias("cats"))
    named = tagged.select("doc_id", F.explode("cats").alias("cat")).groupBy("cat").agg(F.countDistinct("doc_id").alias("n"))
    bare = tagged.where(feeds.in_category(F.col("cats"), feeds.UNCATEGORIZED)).agg(F.lit(feeds.UNCATEGORIZED).alias("cat"), F.count("*").alias("n"))
    return named.unionByName(bare.select("cat", "n"))


@query(f"""
WITH status AS (SELECT {ITEM} AS item_id, max(ts) FILTER (event_type = 'click') AS clicked_at, max(ts) FILTER (event_type = 'error') AS hidden_at
  FROM events WHERE user_id = 7 GROUP BY 1)
SELECT source, count(*) AS total, sum(CASE WHEN clicked_at IS NULL AND hidden_at IS NULL THEN 1 ELSE 0 END)::BIGINT AS unread
FROM documents LEFT JOIN status ON doc_id = item_id GROUP BY source""")
def platform_unread_stats(spark, sf_dir):
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    status = _item(read(spark, sf_dir, "events")).where("user_id = 7").groupBy("item_id", "user_id").agg(last("click").alias("clicked_at"), last("error").alias("hidden_at"))
    items = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source")
    unread = F.col("clicked_at").isNull() & F.col("hidden_at").isNull()
    return feeds.with_status(items, status, 7).groupBy("source").agg(F.count("*").alias("total"), F.count_if(unread).alias("unread"))


@query(f"""
SELECT user_id, {ITEM} AS item_id, count(*) FILTER (event_type = 'purchase') % 2 = 1 AS starred, max(ts) FILTER (event_type = 'click') AS clicked_at,
  max(ts) FILTER (event_type = 'view') AS read_at FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2""")
def user_state_fold(spark, sf_dir):
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    return _item(read(spark, sf_dir, "events")).where("user_id IS NOT NULL").groupBy("user_id", "item_id").agg(
        (F.count_if(F.col("event_type") == "purchase") % 2 == 1).alias("starred"), last("click").alias("clicked_at"), last("view").alias("read_at")
    )


@query("""SELECT coalesce(strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d'), 'unknown') AS day, count(*) AS n FROM events GROUP BY 1""")
def event_timeline_counts(spark, sf_dir):
    day = F.coalesce(F.date_format(times.local_day(F.col("ts")), "yyyy-MM-dd"), F.lit("unknown"))
    return read(spark, sf_dir, "events").groupBy(day.alias("day")).agg(F.count("*").alias("n"))


@query("""
SELECT event_type, event_id, round((row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1) / greatest(count(*) OVER (PARTITION BY event_type) - 1, 1), 6) AS pct
FROM events""")
def engagement_percentile(spark, sf_dir):
    events = feeds.with_percentile(read(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "value", "event_id", "pct")
    return events.select("event_type", "event_id", F.round("pct", 6).alias("pct"))


_RANKED = f"""
WITH seen AS (SELECT {ITEM} AS doc_id, sum(value) AS engagement, max(ts) AS last_at FROM events GROUP BY 1),
rated AS (SELECT d.doc_id, d.source, coalesce(engagement, 0) AS engagement, CASE WHEN last_at IS NOT NULL THEN greatest(epoch(TIMESTAMP '{NOW}' - last_at) / 3600.0, 0) END AS hours,
  least(d.n_chars, 4000) / 4000.0 AS quality FROM documents d LEFT JOIN seen USING (doc_id)),
placed AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY round(engagement, 6), doc_id) - 1) / greatest(count(*) OVER (PARTITION BY source) - 1, 1) AS pct FROM rated),
scored AS (SELECT doc_id, source, round(quality * (1 + 0.1 * pct) / pow(1 + coalesce(hours, 168.0), 1.5), 6) AS score FROM placed)
SELECT doc_id, source, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored ORDER BY score DESC, doc_id LIMIT 100"""


@query(_RANKED)
def rank_feed(spark, sf_dir):
    seen = _item(read(spark, sf_dir, "events")).groupBy("item_id").agg(F.sum("value").alias("engagement"), F.max("ts").alias("last_at"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source", (F.least("n_chars", F.lit(4000)) / 4000).alias("quality"))
    rated = docs.join(seen, "item_id", "left").withColumn("engagement", F.round(F.coalesce("engagement", F.lit(0.0)), 6))
    rated, pct = feeds.with_percentile(rated, "source", "engagement", "item_id", "pct"), F.col("pct")
    now = F.to_timestamp_ntz(F.lit(NOW))
    scored = rated.select(F.col("item_id").alias("doc_id"), "source", scores.ranking(F.col("quality"), pct, times.freshness(times.age_hours(F.col("last_at"), now))).alias("score"))
    top = scored.orderBy(F.desc("score"), "doc_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


@query(f"""
SELECT event_id, {ITEM} AS k, CASE WHEN {ITEM} < 10 THEN 'ungrouped' ELSE 'g' || ({ITEM} // 10) END AS grp
FROM events WHERE {ITEM} < 50 AND event_type <> 'error'""")
def json_props_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    group = F.when(k < 10, "ungrouped").otherwise(F.concat(F.lit("g"), F.floor(k / 10).cast("string")))
    return read(spark, sf_dir, "events").where((k < 50) & (F.col("event_type") != "error")).select("event_id", k.alias("k"), group.alias("grp"))


@query("""
SELECT o_orderkey, o_custkey FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity < 2)
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def semi_anti_visibility(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_quantity")
    poor = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return (
        read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        .join(line.where("l_returnflag = 'R'"), "o_orderkey", "left_semi").join(line.where("l_quantity < 2"), "o_orderkey", "left_anti").join(poor, "o_custkey", "left_anti")
    )


@query("""
SELECT o_orderkey, l_partkey AS cover FROM orders LEFT JOIN (
  SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_linenumber, l_partkey) = 1) ON o_orderkey = l_orderkey""")
def scalar_top1_cover(spark, sf_dir):
    order = F.struct((F.col("l_returnflag") != "R").alias("a"), "l_linenumber", "l_partkey")
    best = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min_by("l_partkey", order).alias("cover"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(best, "o_orderkey", "left")


_STATUS = "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END"


@query(f"""
SELECT o_orderkey, o_orderstatus AS lane, rn, total > 5 AS has_more FROM (
  SELECT o_orderkey, o_orderstatus, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS total
  FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY {_STATUS}, substr(o_orderpriority, 1, 1), o_orderdate DESC, o_orderkey)) WHERE rn <= 5""")
def status_enum_board(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    totals = orders.groupBy("o_orderstatus").agg((F.count("*") > 5).alias("has_more"))
    order = [F.substring("o_orderpriority", 1, 1), F.desc("o_orderdate"), F.col("o_orderkey")]
    top = feeds.top_per_group(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), ["o_orderstatus"], order, 5)
    return top.join(totals, "o_orderstatus").select("o_orderkey", F.col("o_orderstatus").alias("lane"), "rn", "has_more")


@query("""
SELECT doc_id, n_chars, place FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents)
WHERE place > 40 AND doc_id % 3 <> 0 ORDER BY place LIMIT 21""")
def cursor_page(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    ranked = feeds.numbered(docs, "n_chars", "doc_id", "place", descending=True).drop("place_of")
    return feeds.keyset_page(ranked, "place", 40, 20, docs.where("doc_id % 3 = 0"), "doc_id")


@query("""
WITH n AS (SELECT CASE WHEN c_custkey % 10 > 0 THEN c_custkey END AS k FROM customer WHERE c_acctbal < 0)
SELECT 'with null' AS list, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT k FROM n)
UNION ALL SELECT 'without', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM n WHERE k IS NOT NULL)
UNION ALL SELECT 'empty', count(*) FROM orders WHERE o_custkey NOT IN (SELECT k FROM n WHERE k < -1)""")
def not_in_lists(spark, sf_dir):
    """NOT IN beside lists with a null, without one, and empty."""
    orders = read(spark, sf_dir, "orders")
    listed = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.when(F.col("c_custkey") % 10 > 0, F.col("c_custkey")).alias("k"))
    case = lambda name, rows: feeds.not_in(orders, "o_custkey", rows, "k").agg(F.lit(name).alias("list"), F.count("*").alias("n"))
    return case("with null", listed).unionByName(case("without", listed.where("k is not null"))).unionByName(case("empty", listed.where("k < -1")))


@query("""
SELECT kind, id, happened_at FROM (SELECT 'event' AS kind, event_id AS id, ts AS happened_at FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders) ORDER BY happened_at DESC NULLS LAST, kind, id LIMIT 50""")
def library_merge(spark, sf_dir):
    events = read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("happened_at"))
    orders = read(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("happened_at"))
    return feeds.page(events.unionByName(orders), [F.col("happened_at").desc_nulls_last(), F.col("kind"), F.col("id")], 50)


@query("""SELECT place, doc_id, lang FROM (VALUES (1, 17), (2, 3), (3, 99999999), (4, 42), (5, 3)) w(place, id) JOIN documents ON doc_id = id WHERE place <> 5""")
def bundle_in_order(spark, sf_dir):
    wanted = spark.createDataFrame([(1, 17), (2, 3), (3, 99999999), (4, 42), (5, 3)], "place int, doc_id long")
    return feeds.in_order(read(spark, sf_dir, "documents").select("doc_id", "lang"), wanted, "doc_id").select("place", "doc_id", "lang")


@query("""
WITH marked AS (SELECT user_id, ts, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
islands AS (SELECT user_id, place - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM marked WHERE bad)
SELECT user_id, max(n) AS longest, max(n) >= 3 AS broken FROM (SELECT user_id, island, count(*) AS n FROM islands GROUP BY ALL) GROUP BY user_id""")
def consecutive_failures(spark, sf_dir):
    found = feeds.runs(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return found.groupBy("user_id").agg(F.max("length").alias("longest"), (F.max("length") >= 3).alias("broken"))


@query("""
SELECT doc_id, bucket, turn FROM (SELECT doc_id, lang || '/' || coalesce(quality::VARCHAR, 'none') AS bucket,
  row_number() OVER (PARTITION BY lang || '/' || coalesce(quality::VARCHAR, 'none') ORDER BY n_chars DESC, doc_id) AS turn
  FROM documents LEFT JOIN labels USING (doc_id)) ORDER BY turn, bucket LIMIT 40""")
def stratified_sample(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    bucket = F.concat_ws("/", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("none")))
    return feeds.round_robin(docs.select("doc_id", "n_chars", bucket.alias("bucket")), "bucket", [F.desc("n_chars"), F.col("doc_id")], 40).select("doc_id", "bucket", "turn")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, lang, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, lang) = 1""")
def dominant_category(spark, sf_dir):
    return feeds.dominant(read(spark, sf_dir, "documents").select("source", "lang"), "source", "lang", ["fr", "en"])


@query("""
WITH batch AS (SELECT doc_id, lang, source, text FROM documents WHERE doc_id % 3 = 0),
stored AS (SELECT doc_id, lang, source, substr(text, 1, 200) AS text FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(s.doc_id, b.doc_id) AS item_id, coalesce(s.lang, b.lang) AS lang,
  length(CASE WHEN length(coalesce(b.text, '')) > length(coalesce(s.text, '')) THEN b.text ELSE s.text END) AS content_chars,
  coalesce(nullif(CASE WHEN b.doc_id IS NOT NULL AND b.doc_id % 5 = 0 THEN '' ELSE 'new:' || b.source END, ''), 'old:' || s.source) AS author,
  CASE WHEN b.doc_id IS NOT NULL THEN 2 ELSE 1 END AS metrics, s.doc_id IS NULL AS was_inserted
FROM stored s FULL JOIN batch b ON s.doc_id = b.doc_id""")
def upsert_fold(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    shape = lambda df, mark, metrics, text: df.select(
        F.col("doc_id").alias("item_id"), F.lit("t").alias("title"), "lang", text.alias("content"), F.lit("u").alias("url"),
        F.when((F.lit(mark) == "new:") & (F.col("doc_id") % 5 == 0), "").otherwise(F.concat(F.lit(mark), "source")).alias("author"),
        F.lit(None).cast("string").alias("summary"), F.lit(metrics).alias("metrics"))
    old = shape(docs.where("doc_id % 2 = 0"), "old:", 1, F.substring("text", 1, 200))
    new = shape(docs.where("doc_id % 3 = 0"), "new:", 2, F.col("text"))
    return merges.upsert_items(old, new).select("item_id", "lang", F.length("content").cast("long").alias("content_chars"), "author", "metrics", "was_inserted")


@query("""
SELECT d.doc_id, d.source, s.source_id FROM documents d LEFT JOIN (SELECT 'src' || i AS source_key, i + 100 AS source_id, CASE WHEN i % 4 = 0 THEN 'paused' WHEN i % 4 = 1 THEN 'broken' ELSE 'active' END AS status FROM range(0, 15) r(i)) s
ON d.source = s.source_key WHERE s.status IS NULL OR s.status = 'active'""")
def registry_gate(spark, sf_dir):
    i = F.col("id")
    sources = spark.range(15).select(
        (i + 100).alias("source_id"), F.concat(F.lit("src"), i.cast("string")).alias("source_key"),
        F.when(i % 4 == 0, "paused").when(i % 4 == 1, "broken").otherwise("active").alias("status"))
    return merges.registry_gate(read(spark, sf_dir, "documents").select("doc_id", "source"), sources).select("doc_id", "source", "source_id")


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS version FROM part""")
def publish_drafts(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    drafts = part.where("p_size > 25").select("p_partkey", F.upper("p_name").alias("p_name"))
    return merges.publish(part.select("p_partkey", "p_name", F.lit(1).alias("version")), drafts, "p_partkey")


@query("""
SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS orphan_lines,
  (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS bad_vectors, (SELECT count(*) FROM documents) AS items""")
def sync_integrity(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    lost = merges.orphans(read(spark, sf_dir, "lineitem").select("l_orderkey"), orders, "l_orderkey", "o_orderkey").agg(F.count("*").alias("orphan_lines"))
    bad = read(spark, sf_dir, "embeddings").where(F.size("embedding") != 64).agg(F.count("*").alias("bad_vectors"))
    return lost.join(bad).join(read(spark, sf_dir, "documents").agg(F.count("*").alias("items")))


@query("""
SELECT item_id, expectation, rank FROM (SELECT doc_id AS item_id, 'golden' AS expectation, quality AS rank, 0 AS side FROM labels
  UNION ALL SELECT doc_id, 'replay', toxic, 1 FROM labels WHERE doc_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, side DESC) = 1""")
def golden_merge(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    old = labels.select(F.col("doc_id").alias("item_id"), F.lit("golden").alias("expectation"), F.col("quality").alias("rank"))
    new = labels.where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"), F.lit("replay").alias("expectation"), F.col("toxic").alias("rank"))
    return merges.keyed_merge(old, new, "item_id", "rank")
