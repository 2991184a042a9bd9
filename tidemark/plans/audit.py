"""Audits and rollups: order lines stand for processed items, suppliers and users for sources and owners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, times
from ..operators import evaluation, feeds
from .registry import query, read


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS discounted, round(sum(l_quantity), 2) AS quantity,
  grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def audit_rollup(spark, sf_dir):
    flag, status = "l_returnflag", "l_linestatus"
    return read(spark, sf_dir, "lineitem").groupingSets([[flag, status], [flag], []], flag, status).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.grouping_id(flag, status).alias("level"))


@query("""
SELECT l_partkey, count(DISTINCT (l_suppkey, s_nationkey)) AS doc_count, count(DISTINCT s_nationkey) AS unique_sources, count(*) AS members,
  list_sort(list(DISTINCT l_returnflag)) AS platforms, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey HAVING count(*) >= 3""")
def doc_count_vs_unique_source(spark, sf_dir):
    joined = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("l_partkey").agg(
        F.countDistinct("l_suppkey", "s_nationkey").alias("doc_count"), F.countDistinct("s_nationkey").alias("unique_sources"), F.count("*").alias("members"),
        F.sort_array(F.collect_set("l_returnflag")).alias("platforms"), F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at")).where("members >= 3")


@query("""
WITH runs AS (SELECT DISTINCT CAST(ts AS DATE) AS run FROM events ORDER BY run DESC LIMIT 3),
counts AS (SELECT user_id, CAST(ts AS DATE) AS run, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY ALL)
SELECT user_id, count(*) AS runs_with_data, sum(n)::BIGINT AS new_items FROM counts JOIN runs USING (run) GROUP BY user_id HAVING sum(n) = 0""")
def stale_platforms(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("run")).agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    last = counts.select("run").distinct().orderBy(F.desc("run")).limit(3)
    return counts.join(last, "run").groupBy("user_id").agg(F.count("*").alias("runs_with_data"), F.sum("n").alias("new_items")).where("new_items = 0")


@query("""
WITH hits AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-24'
  UNION SELECT user_id, event_id, ts FROM events WHERE event_type = 'click' AND value > 50 AND ts >= TIMESTAMP '2024-01-24')
SELECT c_custkey AS user_id, count(event_id) AS items, max(ts) AS last_at,
  CASE WHEN max(ts) IS NULL OR epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600 >= 72 THEN 'crit' WHEN epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600 >= 24 THEN 'warn' ELSE 'ok' END AS level
FROM customer LEFT JOIN hits ON c_custkey = user_id WHERE c_custkey <= 200 GROUP BY c_custkey""")
def source_health_7d(spark, sf_dir):
    recent = read(spark, sf_dir, "events").where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-24 00:00:00"))).select("user_id", "event_id", "ts", "event_type", "value")
    # the two ways to match are two branches of one union, so neither needs a disjunctive join
    hits = recent.where("event_type = 'view'").unionByName(recent.where("event_type = 'click' AND value > 50")).select("user_id", "event_id", "ts").distinct()
    users = read(spark, sf_dir, "customer").where("c_custkey <= 200").select(F.col("c_custkey").alias("user_id"))
    health = users.join(hits, "user_id", "left").groupBy("user_id").agg(F.count("event_id").alias("items"), F.max("ts").alias("last_at"))
    return health.withColumn("level", times.freshness_level(times.age_hours(F.col("last_at"), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")))))


@query("""
SELECT user_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, round(sum(value), 4) AS used, count(*) AS calls, round(sum(value), 4) > 100 AS over_quota FROM events GROUP BY ALL""")
def quota_by_day(spark, sf_dir):
    used = F.round(F.sum("value"), 4)
    return read(spark, sf_dir, "events").groupBy("user_id", times.local_day(F.col("ts")).alias("day")).agg(used.alias("used"), F.count("*").alias("calls"), (used > 100).alias("over_quota"))


@query("""
SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role, text) AS roles, arg_min(substr(text, 1, 60), turn) FILTER (role = 'user') AS opening
FROM conversations GROUP BY conv_id""")
def conversation_threads(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda r: r["role"]), ">").alias("roles"),
        F.min_by(F.substring("text", 1, 60), F.when(F.col("role") == "user", F.col("turn"))).alias("opening"))


@query("""
SELECT l_suppkey, max(v) FILTER (r = greatest(ceil(0.5 * n), 1)) AS p50, max(v) FILTER (r = greatest(ceil(0.95 * n), 1)) AS p95, max(v) FILTER (r = greatest(ceil(0.99 * n), 1)) AS p99
FROM (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) GROUP BY l_suppkey""")
def latency_nearest_rank(spark, sf_dir):
    return evaluation.nearest_rank(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", [0.5, 0.95, 0.99])


@query("""
WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem WHERE l_orderkey <= 5000)
SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def correlations(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_orderkey <= 5000").select("l_quantity", "l_extendedprice")
    # ranks come from the counted distinct values, so the window runs over those and not over all rows
    def ranked(name):
        values = rows.groupBy(name).agg(F.count("*").alias("c"))
        before = F.coalesce(F.sum("c").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return values.select(name, (before + 1 + (F.col("c") - 1) / 2.0).alias(f"r_{name}"))
    both = rows.join(ranked("l_quantity"), "l_quantity").join(ranked("l_extendedprice"), "l_extendedprice")
    return both.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"), F.round(F.corr("r_l_quantity", "r_l_extendedprice"), 6).alias("spearman"))


_DIMS = "l_linenumber % 4 AS authority, CAST(l_quantity AS BIGINT) % 4 AS substance, l_partkey % 4 AS novelty, l_suppkey % 4 AS timeliness, l_orderkey % 4 AS audience_fit"


@query(f"""
WITH d AS (SELECT l_orderkey, l_linenumber, {_DIMS}, (l_partkey // 4) % 4 AS marketing, CASE WHEN l_discount < 0.03 THEN 'general' ELSE 'product_tool' END AS kind FROM lineitem),
s AS (SELECT *, CASE kind WHEN 'general' THEN (20*authority/3 + 30*substance/3 + 15*novelty/3 + 15*timeliness/3 + 20*audience_fit/3)/10 - marketing/3*2.5
  ELSE (15*authority/3 + 30*substance/3 + 20*novelty/3 + 5*timeliness/3 + 30*audience_fit/3)/10 - marketing/3*3.0 END AS raw FROM d)
SELECT kind, count(*) AS n, count(*) FILTER (round(greatest(least(raw, CASE WHEN authority = 0 OR audience_fit <= 1 THEN 4.9 WHEN novelty = 0 THEN 5.9 ELSE 10 END), 0), 3) >= 4.93) AS high,
  round(avg(greatest(least(raw, CASE WHEN authority = 0 OR audience_fit <= 1 THEN 4.9 WHEN novelty = 0 THEN 5.9 ELSE 10 END), 0)), 1) AS mean FROM s GROUP BY kind""")
def score10_summary(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    dims = {"authority": F.col("l_linenumber") % 4, "substance": F.col("l_quantity").cast("long") % 4, "novelty": F.col("l_partkey") % 4,
            "timeliness": F.col("l_suppkey") % 4, "audience_fit": F.col("l_orderkey") % 4}
    kind = F.when(F.col("l_discount") < 0.03, "general").otherwise("product_tool")
    score = scores.score10(kind, F.lit(0.9), dims, F.floor(F.col("l_partkey") / 4) % 4)
    return line.select(kind.alias("kind"), score.alias("s")).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("s") > 4.9).alias("high"), F.round(F.avg("s"), 1).alias("mean"))


@query("""
WITH best AS (SELECT l_partkey, max(l_discount) AS m, avg(l_discount) AS a, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT l_partkey, round((0.6 * m + 0.4 * a) * ln(1 + n) / ln(1 + 5.0) * n / (n + 1), 6) AS score FROM best""")
def highlight_scores(spark, sf_dir):
    best = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max("l_discount").alias("m"), F.avg("l_discount").alias("a"), F.countDistinct("l_suppkey").alias("n"))
    return best.select("l_partkey", F.round(scores.highlight(F.col("m"), F.col("a"), F.col("n")), 6).alias("score"))


@query("""
SELECT threshold, count(*) FILTER (p >= threshold AND y) AS tp, count(*) FILTER (p >= threshold AND NOT y) AS fp, count(*) FILTER (p < threshold AND y) AS fn,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT least(n_chars, 4000) / 4000.0 AS p, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), (VALUES (0.1), (0.25), (0.5), (0.75)) t(threshold) GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.least("n_chars", F.lit(4000)) / 4000).alias("p")).join(read(spark, sf_dir, "labels"), "doc_id")
    return evaluation.threshold_sweep(rows, [0.1, 0.25, 0.5, 0.75], "p", F.col("quality") == 1)


@query("""
WITH r AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, user_id, value FROM events WHERE event_type = 'view')
SELECT item, count(*) AS runs, round(max(value) - min(value), 6) AS spread, count(*) FILTER (value >= 50) IN (0, count(*)) AS consistent FROM r GROUP BY item HAVING count(*) >= 2""")
def rerun_stability(spark, sf_dir):
    runs = read(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.get_json_object("props", "$.k").cast("long").alias("item"))
    high = F.count_if(F.col("value") >= 50)
    return runs.agg(F.count("*").alias("runs"), F.round(F.max("value") - F.min("value"), 6).alias("spread"), ((high == 0) | (high == F.count("*"))).alias("consistent")).where("runs >= 2")


@query("""
SELECT source, count(*) AS total, count(*) FILTER (lang = 'es') AS lost_lang, count(*) FILTER (n_chars < 300) AS lost_size, count(*) FILTER (lang = 'es' OR n_chars < 300) AS lost_any,
  round(100.0 * count(*) FILTER (lang = 'es' OR n_chars < 300) / count(*), 3) AS lost_percent FROM documents GROUP BY ROLLUP (source)""")
def filter_loss(spark, sf_dir):
    es, small = F.col("lang") == "es", F.col("n_chars") < 300
    return read(spark, sf_dir, "documents").rollup("source").agg(
        F.count("*").alias("total"), F.count_if(es).alias("lost_lang"), F.count_if(small).alias("lost_size"), F.count_if(es | small).alias("lost_any"),
        F.round(100.0 * F.count_if(es | small) / F.count("*"), 3).alias("lost_percent"))


@query("""
WITH s AS (SELECT user_id, bool_or(event_type = 'signup') AS a, bool_or(event_type = 'view') AS b, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS d FROM events GROUP BY user_id)
SELECT count(*) AS seen, count(*) FILTER (a) AS signed, count(*) FILTER (a AND b) AS viewed, count(*) FILTER (a AND b AND c) AS clicked, count(*) FILTER (a AND b AND c AND d) AS bought, count(*) FILTER (d AND NOT a) AS anomalies FROM s""")
def funnel_counts(spark, sf_dir):
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    users = read(spark, sf_dir, "events").groupBy("user_id").agg(has("signup").alias("a"), has("view").alias("b"), has("click").alias("c"), has("purchase").alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    return users.agg(F.count("*").alias("seen"), F.count_if(a).alias("signed"), F.count_if(a & b).alias("viewed"), F.count_if(a & b & c).alias("clicked"),
                     F.count_if(a & b & c & d).alias("bought"), F.count_if(d & ~a).alias("anomalies"))


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'P') AS feedback, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS owner_order,
  arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) AS best_priority FROM orders GROUP BY o_custkey""")
def owner_and_feedback(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        (F.count_if(F.col("o_orderstatus") == "F") - F.count_if(F.col("o_orderstatus") == "P")).alias("feedback"),
        F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("owner_order"),
        F.max_by("o_orderpriority", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("best_priority"))


@query("""
SELECT p.p AS platform, count(event_id) AS n, max(ts) AS last_at FROM (VALUES ('signup'), ('click'), ('share'), ('view')) p(p) LEFT JOIN events ON event_type = p.p GROUP BY 1""")
def platform_list_counts(spark, sf_dir):
    names = spark.createDataFrame([("signup",), ("click",), ("share",), ("view",)], "platform string")
    per = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("platform")).agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))
    return names.join(per, "platform", "left").select("platform", F.coalesce("n", F.lit(0)).alias("n"), "last_at")


@query("""
SELECT event_id, user_id, ts FROM (SELECT event_id, user_id, ts, 0 AS side FROM events WHERE ts >= TIMESTAMP '2024-01-29'
  UNION ALL (SELECT event_id, user_id, ts, 1 FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-26' ORDER BY ts DESC, event_id LIMIT 200)) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY side) = 1""")
def retry_backlog_union(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    run = events.where(feeds.in_window(F.col("ts"), "2024-01-29 00:00:00", "9999-01-01 00:00:00"))
    late = events.where("event_type = 'error'").where(feeds.in_window(F.col("ts"), "2024-01-26 00:00:00", "9999-01-01 00:00:00")).orderBy(F.desc("ts"), "event_id").limit(200)
    return run.unionByName(late).drop("event_type").dropDuplicates(["event_id"])


@query("""
SELECT l_partkey, arg_min(l_suppkey, (-n, l_suppkey)) AS target, sum(n)::BIGINT AS merged FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_partkey""")
def merge_target(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return n.groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct(-F.col("n"), F.col("l_suppkey"))).alias("target"), F.sum("n").alias("merged"))


@query("""
WITH c AS (SELECT l_partkey % 97 AS t, l_suppkey % 89 * 10 + l_partkey % 7 AS p, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY ALL),
ts AS (SELECT sum(n) AS n, count(*) AS k FROM c GROUP BY t), ps AS (SELECT sum(n) AS n, count(*) AS k FROM c GROUP BY p)
SELECT ((SELECT sum(n) * (sum(n) - 1) / 2 FROM c) - (SELECT sum(n * (n - 1) / 2) FROM ts) - (SELECT sum(n * (n - 1) / 2) FROM ps) + (SELECT sum(n * (n - 1) / 2) FROM c))::BIGINT AS tn,
  (SELECT count(*) FROM ps WHERE k > 1) AS over_merged, (SELECT coalesce(sum(n), 0)::BIGINT FROM ps WHERE k > 1) AS in_over_merged, (SELECT count(*) FROM ts WHERE k > 1) AS split, (SELECT sum(n)::BIGINT FROM c) AS items""")
def cluster_faults(spark, sf_dir):
    """Large order lines, grouped by supplier where they should be grouped by part."""
    line = read(spark, sf_dir, "lineitem").where("l_quantity > 45")
    marked = line.select((F.col("l_partkey") % 97).alias("truth"), (F.col("l_suppkey") % 89 * 10 + F.col("l_partkey") % 7).alias("found"))
    return evaluation.cluster_faults(marked, "truth", "found")
