"""Action boards: orders stand for actions, their lines for the items behind them, customers for users."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import actions
from .registry import query, read

_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'executing' ELSE 'needs_verification' END END"
_STATUSES = ("pending", "confirmed", "executing", "needs_verification", "completed")


def _actions(spark, sf_dir):
    return read(spark, sf_dir, "orders").withColumn("status", F.expr(_STATUS))


@query(f"""
SELECT o_orderkey AS action_id, o_custkey AS user_id, status, o_orderdate AS created_at FROM (
  SELECT o_orderkey, o_custkey, {_STATUS} AS status, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate, o_orderpriority FROM orders)
WHERE status IN ('confirmed', 'executing', 'needs_verification') AND o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND (o_orderdate IS NULL OR CAST(o_orderdate AS DATE) BETWEEN DATE '2000-03-01' - 364 AND DATE '2000-03-01')
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100""")
def action_page(spark, sf_dir):
    """Status, priority and date filters of a board; rows without a date pass; the limit of 500 asked for is clamped to 100."""
    rows = _actions(spark, sf_dir).withColumn("o_orderdate", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")))
    found = rows.where(
        actions.has_status(F.col("status"), "in_progress") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        & actions.in_last_days(F.col("o_orderdate"), F.lit("2000-03-01").cast("date"), 365)
    )
    return found.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(actions.clamped(500)).select(
        F.col("o_orderkey").alias("action_id"), F.col("o_custkey").alias("user_id"), "status", F.col("o_orderdate").alias("created_at"))


@query(f"""
WITH a AS (SELECT {_STATUS} AS status FROM orders),
lanes AS (SELECT status FROM a UNION ALL SELECT 'in_progress' FROM a WHERE status IN ('confirmed', 'executing', 'needs_verification') UNION ALL SELECT 'total' FROM a)
SELECT status, count(*) AS n, list_position(['pending', 'confirmed', 'executing', 'needs_verification', 'completed', 'in_progress', 'total'], status) AS place FROM lanes GROUP BY status""")
def action_counts(spark, sf_dir):
    return actions.status_counts(_actions(spark, sf_dir), "status", _STATUSES)


@query(f"""
WITH ids AS (SELECT l_orderkey, list(DISTINCT CAST(l_partkey AS VARCHAR)) AS ids FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT {_STATUS} AS status, ids IS NOT NULL AS has_sources, count(*) AS n FROM orders LEFT JOIN ids ON o_orderkey = l_orderkey GROUP BY ALL""")
def actions_with_sources(spark, sf_dir):
    """The source filter's test on JSON arrays: an empty or missing array is an action without sources."""
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.to_json(F.collect_set(F.col("l_partkey").cast("string"))).alias("source_item_ids"))
    joined = _actions(spark, sf_dir).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("source_item_ids", F.coalesce("source_item_ids", F.lit("[]")))
    return joined.groupBy("status", (F.size(actions.ids_of(F.col("source_item_ids"))) > 0).alias("has_sources")).agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey AS action_id, count(DISTINCT l_partkey) AS items FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_partkey IN (7, 19, 77, 150))""")
def actions_of_items(spark, sf_dir):
    """Membership in JSON arrays: a text search first, then the exact one (7 is part of 77 as text, not as an id)."""
    ids = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_set(F.col("l_partkey").cast("string"))).alias("ids"))
    wanted = F.lit(False)
    for item in ("7", "19", "77", "150"):
        wanted = wanted | actions.holds_id(F.col("ids"), item)
    return ids.where(wanted).select(F.col("l_orderkey").alias("action_id"), F.size(actions.ids_of(F.col("ids"))).alias("items"))


@query("""
SELECT p_partkey AS action_id, p_name AS title, p_size AS steps FROM (
  SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'old ' || p_name WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS o1, CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS o2,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS o3, CASE WHEN p_partkey % 19 = 0 THEN 'LARGE!' ELSE p_type END AS o4 FROM part)
WHERE o1 <> p_name OR o2 <> p_size OR o3 <> p_brand OR o4 <> p_type""")
def edited_actions(spark, sf_dir):
    key = F.col("p_partkey")
    part = read(spark, sf_dir, "part").withColumns({
        "original_name": F.when(key % 7 == 0, F.concat(F.lit("old "), "p_name")).when(key % 11 != 0, F.col("p_name")),
        "original_size": F.when(key % 13 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")),
        "original_brand": F.when(key % 17 != 0, F.col("p_brand")), "original_type": F.when(key % 19 == 0, "LARGE!").otherwise(F.col("p_type"))})
    pairs = [(f"original_{c}", f"p_{c}") for c in ("name", "size", "brand", "type")]
    return part.where(actions.edited(pairs)).select(key.alias("action_id"), F.col("p_name").alias("title"), F.col("p_size").alias("steps"))


@query("""
SELECT o_custkey AS user_id, count(*) AS actions, count(f.l_orderkey) AS with_log, max(f.at) AS last_log FROM orders LEFT JOIN
  (SELECT l_orderkey, max(l_shipdate) AS at FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey) f ON o_orderkey = f.l_orderkey GROUP BY o_custkey""")
def actions_with_logs(spark, sf_dir):
    """A left join whose other side is filtered in the join: actions without such a log stay."""
    logs = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("at"))
    joined = read(spark, sf_dir, "orders").join(logs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("actions"), F.count("l_orderkey").alias("with_log"), F.max("at").alias("last_log"))


@query("""
WITH f AS (SELECT user_id, event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL)
SELECT k.kind, coalesce(sum(f.n), 0)::BIGINT AS n, (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM orders) AS actions
FROM (VALUES ('click'), ('view'), ('purchase'), ('share')) k(kind) LEFT JOIN f ON f.kind = k.kind GROUP BY k.kind""")
def feedback_summary(spark, sf_dir):
    """Counts of a fixed list of kinds, those that never occur among them, beside the counts of two tables."""
    kinds = spark.createDataFrame([("click",), ("view",), ("purchase",), ("share",)], "kind string")
    counts = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    users, acts = (read(spark, sf_dir, t).agg(F.count("*").alias(name)) for t, name in (("customer", "users"), ("orders", "actions")))
    return kinds.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n")).join(users).join(acts)


@query("""
WITH m AS (SELECT user_id, event_id, value AS score, event_id % 4 = 0 AS is_new FROM events WHERE event_type = 'purchase')
SELECT m.user_id, count(*) AS total, sum(m.is_new::INT)::BIGINT AS new, count(s.event_id) AS with_status, round(max(m.score), 4) AS best
FROM m JOIN customer ON c_custkey = m.user_id LEFT JOIN (SELECT DISTINCT event_id - 1 AS event_id FROM events WHERE event_type = 'view') s ON s.event_id = m.event_id GROUP BY m.user_id""")
def interest_matches(spark, sf_dir):
    """Matches joined to their items and, where there is one, to the reader's status; totals and new ones."""
    events = read(spark, sf_dir, "events")
    matches = events.where("event_type = 'purchase'").select("user_id", "event_id", F.col("value").alias("score"), (F.col("event_id") % 4 == 0).alias("is_new"))
    status = events.where("event_type = 'view'").select((F.col("event_id") - 1).alias("event_id"), F.lit(1).alias("seen")).distinct()
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return matches.join(users, "user_id").join(status, "event_id", "left").groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if("is_new").alias("new"), F.count("seen").alias("with_status"), F.round(F.max("score"), 4).alias("best"))


@query("""
SELECT o_custkey AS user_id, count(*) AS models, count(*) FILTER (o_orderdate >= c.at) AS fresh FROM orders JOIN
  (SELECT l_orderkey, max(l_shipdate) - INTERVAL 60 DAY AS at FROM lineitem GROUP BY l_orderkey) c ON o_orderkey = c.l_orderkey WHERE o_orderstatus <> 'F' GROUP BY o_custkey""")
def read_model_freshness(spark, sf_dir):
    """Read models joined to their actions; a model is fresh if it is not older than what it was made of."""
    made = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.max("l_shipdate") - F.expr("INTERVAL 60 DAYS")).alias("at"))
    joined = read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").join(made, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("models"), F.count_if(F.col("o_orderdate") >= F.col("at")).alias("fresh"))


@query("""
SELECT p_name AS direction, min(p_type) AS label, count(*) AS n FROM part GROUP BY p_name""")
def direction_counts(spark, sf_dir):
    """A label beside its group: any would do, the smallest makes reruns agree."""
    return read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("direction")).agg(F.min("p_type").alias("label"), F.count("*").alias("n"))


@query("""
WITH a AS (SELECT p_name AS title, p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part GROUP BY ALL),
m AS (SELECT title, string_agg(ids, ',' ORDER BY p_brand) AS ids, string_agg(p_brand, chr(10) ORDER BY p_brand) AS reasons, count(*) AS merged FROM a GROUP BY title)
SELECT title, ids, CASE WHEN title LIKE '%ring%' THEN reasons ELSE reasons || chr(10) || title END AS reason, merged FROM m""")
def merged_actions(spark, sf_dir):
    """Actions of one title merged: ids united in order, reasons appended unless they are part of what is there."""
    one = read(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.transform(F.sort_array(F.collect_list("p_partkey")), lambda x: x.cast("string")).alias("ids"))
    parts = F.sort_array(F.collect_list(F.struct("p_brand", "ids")))
    merged = one.groupBy(F.col("p_name").alias("title")).agg(parts.alias("parts"), F.count("*").alias("merged")).withColumns({
        "ids": F.aggregate("parts", F.array().cast("array<string>"), lambda a, x: actions.ordered_union(a, x["ids"])),
        "reasons": F.aggregate("parts", F.lit(""), lambda a, x: actions.appended(a, x["p_brand"]))})
    extra = F.when(~F.col("title").contains("ring"), F.col("title")).otherwise(F.substring("reasons", 1, 5))
    return merged.select("title", F.array_join("ids", ",").alias("ids"), actions.appended(F.col("reasons"), extra).alias("reason"), "merged")


@query("""
SELECT title, doc_id FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS title, p_partkey AS doc_id FROM part)
QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY doc_id) = 1""")
def names_kept_first(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("title"), F.col("p_partkey").alias("doc_id"))
    return actions.keep_first_of_case(names, "title", "doc_id")


@query("""
WITH new AS (SELECT p_partkey AS id, lower(trim(p_name || ' ' || p_type || CASE p_partkey % 3 WHEN 0 THEN '' ELSE ' ' || p_brand END)) AS a FROM part WHERE p_partkey % 5 = 0),
known AS (SELECT DISTINCT lower(trim(CASE p_partkey % 3 WHEN 0 THEN p_name ELSE p_name || ' ' || p_type END)) AS b FROM part WHERE p_partkey % 5 = 1)
SELECT id FROM new WHERE NOT EXISTS (SELECT 1 FROM known WHERE a = b OR length(a) > 10 AND contains(b, a) OR length(b) > 10 AND contains(a, b))""")
def titles_not_known(spark, sf_dir):
    part, key = read(spark, sf_dir, "part"), F.col("p_partkey")
    new = part.where("p_partkey % 5 = 0").select(key.alias("id"), F.concat_ws(" ", "p_name", "p_type", F.when(key % 3 != 0, F.col("p_brand"))).alias("title"))
    known = part.where("p_partkey % 5 = 1").select(F.when(key % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("title"))
    return actions.new_titles(new, known).select("id")


@query(f"""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['pending', 'confirmed', 'executing', 'needs_verification', 'completed'], status)) AS rank
FROM (SELECT o_custkey AS user_id, {_STATUS} AS status, count(*) AS n FROM orders GROUP BY ALL)""")
def lanes_in_board_order(spark, sf_dir):
    """Lanes ranked by the board's own order of statuses, which is neither alphabetical nor by count."""
    lanes = _actions(spark, sf_dir).groupBy(F.col("o_custkey").alias("user_id"), "status").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(s) for s in _STATUSES]), F.col("status"))
    return lanes.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(place)))
