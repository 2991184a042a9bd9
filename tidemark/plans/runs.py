"""Fetch runs: days of events stand for runs, events for the items that they bring, order lines for backlogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from .registry import query, read

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _run_items(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.dayofmonth("ts").alias("run_id"), (F.col("event_type") != "view").alias("was_inserted"))


@query("""
WITH r AS (SELECT event_id AS item_id, event_type <> 'view' AS was_inserted FROM events WHERE day(ts) BETWEEN 10 AND 12)
SELECT user_id, count(*) FILTER (event_id IN (SELECT item_id FROM r)) AS tagged, count(*) FILTER (event_id IN (SELECT item_id FROM r WHERE was_inserted)) AS inserted,
  count(*) FILTER (event_id NOT IN (SELECT item_id FROM r WHERE was_inserted)) AS others FROM events GROUP BY user_id""")
def run_scopes(spark, sf_dir):
    """Items of three runs: all that they touched, those that they inserted, and the complement of the latter."""
    items = read(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), "user_id")
    mine = _run_items(spark, sf_dir).where("run_id BETWEEN 10 AND 12")
    parts = [(runs.in_run(items, mine), "tagged"), (runs.in_run(items, mine, True), "inserted"), (runs.outside_run(items, mine, True), "others")]
    each = None
    for rows, name in parts:
        rows = rows.withColumn("scope", F.lit(name))
        each = rows if each is None else each.unionByName(rows)
    return each.groupBy("user_id").agg(*[F.count_if(F.col("scope") == name).alias(name) for _, name in parts])


@query("""
WITH runs AS (SELECT range AS run_id, make_timestamp(2024, 1, range, 3, 0, 0) AS started_at, make_timestamp(2024, 1, range, 9, 30, 0) + INTERVAL 1 DAY AS finished_at FROM range(1, 28)),
recorded AS (SELECT day(ts) AS run_id, event_id AS item_id, event_type <> 'view' AS was_inserted FROM events WHERE day(ts) % 3 > 0),
found AS (SELECT run_id, item_id FROM recorded WHERE was_inserted AND run_id < 28
  UNION SELECT run_id, event_id FROM runs JOIN events ON ts BETWEEN started_at AND finished_at WHERE run_id NOT IN (SELECT run_id FROM recorded))
SELECT run_id, event_type AS platform, count(*) AS items FROM found JOIN events ON event_id = item_id GROUP BY ALL""")
def new_run_items(spark, sf_dir):
    """What runs brought, by platform: as recorded, or by the run's bounds where nothing was recorded."""
    bounds = spark.range(1, 28).select(
        F.col("id").cast("int").alias("run_id"), F.expr("make_timestamp_ntz(2024, 1, int(id), 3, 0, 0)").alias("started_at"),
        (F.expr("make_timestamp_ntz(2024, 1, int(id), 9, 30, 0)") + F.expr("INTERVAL 1 DAY")).alias("finished_at"))
    events = read(spark, sf_dir, "events")
    items = events.select(F.col("event_id").alias("item_id"), F.col("ts").alias("created_at"))
    recorded = _run_items(spark, sf_dir).where("run_id % 3 > 0")
    found = runs.new_items(bounds, items, recorded).where("run_id < 28")
    return found.join(events.select(F.col("event_id").alias("item_id"), F.col("event_type").alias("platform")), "item_id").groupBy("run_id", "platform").agg(F.count("*").alias("items"))


@query("""
SELECT day(ts) AS run_id, event_type AS platform, grouping(event_type) AS level, count(*) AS items, count(*) FILTER (value < 10) AS summarized, count(*) FILTER (value >= 100) AS failed,
  count(*) FILTER (value BETWEEN 10 AND 100 AND value < 100) AS pending, count(DISTINCT CASE WHEN value >= 5 THEN user_id END) AS touched, floor(epoch(max(ts) - min(ts)))::BIGINT AS seconds
FROM events GROUP BY GROUPING SETS ((day(ts), event_type), (day(ts)))""")
def fetch_run_audit(spark, sf_dir):
    """Each run's counts by platform and in all: done, failed and pending items, clusters touched, and how long it took."""
    value = F.col("value")
    rows = read(spark, sf_dir, "events").withColumn("run_id", F.dayofmonth("ts"))
    return rows.groupingSets([["run_id", "event_type"], ["run_id"]], "run_id", "event_type").agg(
        F.grouping("event_type").alias("level"), F.count("*").alias("items"), F.count_if(value < 10).alias("summarized"), F.count_if(value >= 100).alias("failed"),
        F.count_if((value >= 10) & (value < 100)).alias("pending"), F.countDistinct(F.when(value >= 5, F.col("user_id"))).alias("touched"),
        F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("seconds"),
    ).withColumnRenamed("event_type", "platform")


@query("""
WITH i AS (SELECT event_id AS item_id, event_type AS platform, day(ts) AS run_id, CASE WHEN value >= 10 THEN value END AS score, CASE WHEN event_id % 7 > 2 THEN user_id END AS cluster_id, event_id % 11 = 0 AS failed FROM events)
SELECT item_id, run_id, CASE WHEN failed THEN 'failed' WHEN score IS NULL THEN 'pending' ELSE 'done' END AS ai_status, CASE WHEN cluster_id IS NULL THEN 'none' WHEN score >= 50 THEN 'visible' ELSE 'draft' END AS cluster_status,
  CASE WHEN platform IN ('click', 'view') THEN 'feed' ELSE platform END AS pill FROM i ORDER BY run_id DESC, item_id LIMIT 200 OFFSET 100""")
def audit_item_page(spark, sf_dir):
    """One page of a run's items with their derived states."""
    e = read(spark, sf_dir, "events")
    score, cluster = F.when(F.col("value") >= 10, F.col("value")), F.when(F.col("event_id") % 7 > 2, F.col("user_id"))
    rows = e.select(
        F.col("event_id").alias("item_id"), F.dayofmonth("ts").alias("run_id"), F.when(F.col("event_id") % 11 == 0, "failed").when(score.isNull(), "pending").otherwise("done").alias("ai_status"),
        F.when(cluster.isNull(), "none").when(score >= 50, "visible").otherwise("draft").alias("cluster_status"),
        F.when(F.col("event_type").isin("click", "view"), "feed").otherwise(F.col("event_type")).alias("pill"))
    return rows.orderBy(F.desc("run_id"), "item_id").offset(100).limit(200)


@query("""
WITH i AS (SELECT source, CASE WHEN doc_id % 5 > 0 THEN text END AS summary, CASE WHEN doc_id % 7 > 0 THEN lang END AS category, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS embedding,
  CASE WHEN doc_id % 11 > 2 THEN doc_id END AS cluster_id, n_chars, doc_id % 13 AS retries FROM documents)
SELECT source, count(*) FILTER ((summary IS NULL OR category IS NULL) AND retries < 10) AS enrichment, count(*) FILTER (summary IS NOT NULL AND embedding IS NULL) AS embedding,
  count(*) FILTER (embedding IS NOT NULL AND cluster_id IS NULL) AS clustering, count(*) FILTER (cluster_id IS NOT NULL AND summary IS NULL) AS summary, count(*) FILTER (n_chars >= 2000 AND cluster_id IS NULL) AS high_score
FROM i GROUP BY source""")
def pending_work(spark, sf_dir):
    """What is still to do, by source: nulls in any of several columns, ready for another try, high scores first."""
    key = F.col("doc_id")
    items = read(spark, sf_dir, "documents").select(
        "source", F.when(key % 5 > 0, F.lit(1)).alias("summary"), F.when(key % 7 > 0, F.col("lang")).alias("category"), F.when(key % 3 > 0, key).alias("embedding"),
        F.when(key % 11 > 2, key).alias("cluster_id"), "n_chars", (key % 13).alias("retries"))
    null = lambda c: F.col(c).isNull()
    return items.groupBy("source").agg(*runs.pending({
        "enrichment": (null("summary") | null("category")) & (F.col("retries") < 10), "embedding": ~null("summary") & null("embedding"),
        "clustering": ~null("embedding") & null("cluster_id"), "summary": ~null("cluster_id") & null("summary"), "high_score": (F.col("n_chars") >= 2000) & null("cluster_id")}))


@query(f"""
WITH last AS (SELECT user_id, max(ts) - INTERVAL 5 DAY AS scanned_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.user_id, count(*) AS all_items, count(*) FILTER (ts >= {_NOW} - INTERVAL 7 DAY) AS last_7d, count(*) FILTER (ts >= {_NOW} - INTERVAL 30 DAY) AS last_30d,
  count(*) FILTER (scanned_at IS NULL OR ts > scanned_at) AS since_scan FROM events e LEFT JOIN last USING (user_id) GROUP BY e.user_id""")
def scan_scopes(spark, sf_dir):
    """The scopes of an interest scan: all, a week, 30 days, since the last scan."""
    e, now = read(spark, sf_dir, "events"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg((F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("scanned_at"))
    since = lambda days: F.count_if(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return e.join(last, "user_id", "left").groupBy("user_id").agg(
        F.count("*").alias("all_items"), since(7).alias("last_7d"), since(30).alias("last_30d"), F.count_if(F.col("scanned_at").isNull() | (F.col("ts") > F.col("scanned_at"))).alias("since_scan"))


@query(f"""
SELECT event_id, user_id, value FROM events WHERE ts >= {_NOW} - INTERVAL 48 HOUR AND value >= 20 ORDER BY value DESC, event_id""")
def briefing_candidates(spark, sf_dir):
    recent = F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - INTERVAL 48 HOURS")
    return read(spark, sf_dir, "events").where(recent & (F.col("value") >= 20)).orderBy(F.desc("value"), "event_id").select("event_id", "user_id", "value")


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS platforms FROM c GROUP BY user_id""")
def counts_without_disabled(spark, sf_dir):
    """Maps of counts by platform, without the platforms that are switched off."""
    each = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = each.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("counts"))
    kept = runs.kept_keys(F.col("counts"), ["error", "signup"])
    text = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return maps.select("user_id", text.alias("platforms")).where("platforms <> ''")


@query("""
SELECT CASE WHEN day(ts) % 5 = 0 THEN 'attached' ELSE 'left' END AS state, count(*) AS n, min(event_id) AS first_id FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND (value IS NULL OR value < 5 OR event_type = 'error' OR user_id % 9 = 0 OR json_extract(props, '$.k')::INT > 95) GROUP BY 1""")
def unfinished_in_window(spark, sf_dir):
    """Items of a time window of which any of five things is unfinished, attached to a run or left."""
    value, ts = F.col("value"), F.col("ts")
    open_ = value.isNull() | (value < 5) | (F.col("event_type") == "error") | (F.col("user_id") % 9 == 0) | (F.get_json_object("props", "$.k").cast("int") > 95)
    rows = read(spark, sf_dir, "events").where((ts >= F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'")) & (ts < F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'")) & open_)
    return rows.groupBy(F.when(F.dayofmonth("ts") % 5 == 0, "attached").otherwise("left").alias("state")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"""
WITH r AS (SELECT user_id AS run_id, min(ts) AS started_at, max(ts) FILTER (event_type = 'click') AS heartbeat, bool_or(event_type = 'purchase' AND value > 60) AS ended FROM events GROUP BY user_id)
SELECT run_id, CASE WHEN ended THEN 'success' WHEN epoch(({_NOW}) - coalesce(heartbeat, started_at)) > 24 * 3600 THEN 'failed' ELSE 'running' END AS status FROM r""")
def stale_runs(spark, sf_dir):
    """Runs without an end whose last sign of life is a day old have failed."""
    r = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.min("ts").alias("started_at"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("heartbeat"),
        F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 60)).alias("ended"))
    old = runs.stale(F.col("started_at"), F.col("heartbeat"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), 24)
    return r.select("run_id", F.when(F.col("ended"), "success").when(old, "failed").otherwise("running").alias("status"))


@query("""
WITH i AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS published_at, CASE WHEN o_orderkey % 6 > 0 THEN o_custkey END AS run_id FROM orders),
b AS (SELECT l_orderkey, min(l_shipdate) AS later_at, min(l_suppkey) AS later_run FROM lineitem GROUP BY l_orderkey)
SELECT item_id, coalesce(published_at, later_at) AS published_at, coalesce(run_id, later_run) AS run_id FROM i LEFT JOIN b ON item_id = l_orderkey""")
def backfilled(spark, sf_dir):
    """Nulls filled from what was fetched later; what is there stays."""
    key = F.col("o_orderkey")
    items = read(spark, sf_dir, "orders").select(key.alias("item_id"), F.when(key % 4 > 0, F.col("o_orderdate")).alias("published_at"), F.when(key % 6 > 0, F.col("o_custkey")).alias("run_id"))
    later = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.min("l_shipdate").alias("at"), F.min("l_suppkey").alias("run"))
    return items.join(later, "item_id", "left").select("item_id", F.coalesce("published_at", "at").alias("published_at"), F.coalesce("run_id", "run").alias("run_id"))


@query("""
WITH ready AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N' AND l_quantity >= 10)
SELECT l_suppkey AS source, count(*) AS ready, count(DISTINCT l_orderkey) FILTER (l_partkey % 2 = 0 OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) AS drafts FROM ready GROUP BY l_suppkey""")
def ready_candidates(spark, sf_dir):
    """Ready items, and the distinct draft clusters among them by either of two conditions."""
    line = read(spark, sf_dir, "lineitem").where("l_returnflag = 'N' AND l_quantity >= 10").select("l_orderkey", "l_partkey", "l_suppkey")
    open_ = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("open"))
    draft = F.when((F.col("l_partkey") % 2 == 0) | F.col("open"), F.col("l_orderkey"))
    return line.join(open_, "l_orderkey", "left").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("ready"), F.countDistinct(draft).alias("drafts"))


@query("""
SELECT l_suppkey AS source, max(try_cast(t AS TIMESTAMP)) AS last_at, count(*) FILTER (try_cast(t AS TIMESTAMP) IS NULL) AS unparsed FROM (
  SELECT l_suppkey, CASE l_orderkey % 4 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN 'n/a' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS t FROM lineitem) GROUP BY l_suppkey""")
def last_parseable(spark, sf_dir):
    """The latest time of a source among texts of which some are no times."""
    key = F.col("l_orderkey") % 4
    text = F.when(key == 0, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).when(key == 1, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).when(key == 2, "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.expr("1").alias("one"), text.alias("t")).withColumn("at", F.try_to_timestamp("t").cast("timestamp_ntz"))
    return rows.groupBy("source").agg(F.max("at").alias("last_at"), F.count_if(F.col("at").isNull()).alias("unparsed"))


@query("""
WITH s AS (SELECT user_id, round(max(value), 4) AS score, true AS is_new, count(*) AS hits FROM events WHERE day(ts) <= 15 AND user_id % 3 > 0 GROUP BY user_id),
b AS (SELECT user_id, round(min(value), 4) AS score, false AS is_new, count(*) AS hits FROM events WHERE day(ts) > 15 AND user_id % 4 > 0 GROUP BY user_id)
SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(b.score, s.score) AS score, coalesce(s.is_new, b.is_new) AS is_new, coalesce(s.hits, 0) + coalesce(b.hits, 0) AS hits FROM s FULL JOIN b ON s.user_id = b.user_id""")
def keyed_counters(spark, sf_dir):
    e, day = read(spark, sf_dir, "events"), F.dayofmonth("ts")
    fold = lambda rows, f, new: rows.groupBy("user_id").agg(F.round(f("value"), 4).alias("score"), F.lit(new).alias("is_new"), F.count("*").alias("hits"))
    return runs.merged_counters(fold(e.where((day <= 15) & (F.col("user_id") % 3 > 0)), F.max, True), fold(e.where((day > 15) & (F.col("user_id") % 4 > 0)), F.min, False), "user_id")


@query("""
SELECT s_suppkey AS source_id, n_name AS platform, CASE s_suppkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'degraded' WHEN 2 THEN 'broken' ELSE 'paused' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE s_suppkey % 4 = 0 OR s_suppkey % 4 = 1 AND n_regionkey <> 2 OR s_suppkey % 4 = 2 AND n_regionkey = 3""")
def active_sources(spark, sf_dir):
    """Which statuses count as active depends on the platform."""
    status = F.element_at(F.array(*[F.lit(s) for s in ("active", "degraded", "broken", "paused")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("status", status)
    allowed = F.when(F.col("n_regionkey") == 2, F.array(F.lit("active"))).when(F.col("n_regionkey") == 3, F.array(F.lit("active"), F.lit("degraded"), F.lit("broken"))).otherwise(F.array(F.lit("active"), F.lit("degraded")))
    return rows.where(F.array_contains(allowed, F.col("status"))).select(F.col("s_suppkey").alias("source_id"), F.col("n_name").alias("platform"), "status")


@query(f"""
SELECT user_id, count(*) AS sessions FROM events WHERE ts + INTERVAL 72 HOUR * (1 + user_id % 3) >= {_NOW} GROUP BY user_id""")
def unexpired_sessions(spark, sf_dir):
    """What a clean-up leaves: rows whose time to live has not run out."""
    expires = F.col("ts") + F.make_dt_interval((3 * (1 + F.col("user_id") % 3)).cast("int"))
    return read(spark, sf_dir, "events").where(expires >= F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")).groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("""
SELECT l_returnflag AS dimension, count(*) AS rows_before, count(*) FILTER (l_orderkey % 10 <> 3) AS rows_after FROM lineitem GROUP BY l_returnflag""")
def pruned_dimensions(spark, sf_dir):
    """Row counts by dimension before a prune of some keys, and after it."""
    line = read(spark, sf_dir, "lineitem")
    cut = line.where("l_orderkey % 10 = 3").select("l_orderkey").distinct().withColumn("cut", F.lit(1))
    return line.join(cut, "l_orderkey", "left").groupBy(F.col("l_returnflag").alias("dimension")).agg(F.count("*").alias("rows_before"), F.count_if(F.col("cut").isNull()).alias("rows_after"))


@query("""
SELECT p_partkey AS item_id, p_type AS old, new FROM (SELECT *, CASE WHEN p_name LIKE 'red%' AND p_size > 20 THEN 'PROMO' WHEN p_name LIKE '%bolt' THEN 'STANDARD' WHEN p_retailprice < 905 THEN 'ECONOMY' ELSE p_type END AS new FROM part) WHERE new <> p_type""")
def relabelled(spark, sf_dir):
    """Labels by rules, first one wins; only rows whose label changes are given out."""
    name = F.col("p_name")
    new = F.when(name.startswith("red") & (F.col("p_size") > 20), "PROMO").when(name.endswith("bolt"), "STANDARD").when(F.col("p_retailprice") < 905, "ECONOMY").otherwise(F.col("p_type"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("old"), new.alias("new")).where("new <> old")


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN '(none)' WHEN value > 50 THEN 'top-confidence-match' WHEN value > 10 THEN 'all-low-confidence' ELSE 'no-same-event-match' END AS reason FROM events) GROUP BY reason""")
def judge_outcomes(spark, sf_dir):
    value = F.col("value")
    reason = F.when(F.col("event_type") != "error", F.when(value > 50, "top-confidence-match").when(value > 10, "all-low-confidence").otherwise("no-same-event-match"))
    return read(spark, sf_dir, "events").groupBy(F.coalesce(reason, F.lit("(none)")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT doc_id, n_chars, 4 * contains(lower(text), 'license')::INT + 4 * contains(lower(text), 'http')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT AS score FROM documents),
top AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, n_chars DESC, doc_id LIMIT 50)
SELECT top.doc_id, score, md5(text) AS body FROM top JOIN documents USING (doc_id)""")
def two_phase_top(spark, sf_dir):
    """The best candidates by weighted terms over light columns; the heavy column is fetched for the winners only."""
    docs, low = read(spark, sf_dir, "documents"), F.lower("text")
    score = sum((F.when(low.contains(t), w).otherwise(0) for t, w in (("license", 4), ("http", 4), ("the", 1), ("und", 1))), F.lit(0))
    top = docs.select("doc_id", "n_chars", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("n_chars"), "doc_id").limit(50)
    return docs.join(top.select("doc_id", "score"), "doc_id").select("doc_id", "score", F.md5("text").alias("body"))


@query("""
SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND CASE WHEN value > 60 THEN 2 WHEN value > 20 THEN 1 ELSE 0 END >= 1""")
def confident_outputs(spark, sf_dir):
    """Outputs of the wanted kinds whose confidence, an ordinal, is medium at least."""
    levels = F.create_map(*[x for k, v in (("low", 0), ("medium", 1), ("high", 2)) for x in (F.lit(k), F.lit(v))])
    name = F.when(F.col("value") > 60, "high").when(F.col("value") > 20, "medium").otherwise("low")
    return read(spark, sf_dir, "events").where(F.array_contains(F.array(F.lit("click"), F.lit("purchase")), F.col("event_type")) & (levels[name] >= levels["medium"])).select("event_id")
