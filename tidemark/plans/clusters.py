"""Event clusters: users' weeks of events and parts' order lines stand for clusters and their members."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters
from .registry import query, read

_WEEKS = "SELECT user_id * 100 + week(ts) AS cluster_id, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE event_type = 'view' GROUP BY 1"


def _weeks(spark, sf_dir):
    views = read(spark, sf_dir, "events").where("event_type = 'view'")
    return views.groupBy((F.col("user_id") * 100 + F.weekofyear("ts")).alias("cluster_id")).agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query(f"""
WITH c AS ({_WEEKS}), i AS (SELECT event_id AS item_id, ts AS t FROM events WHERE event_type = 'purchase' AND value > 20),
m AS (SELECT item_id, cluster_id, round(greatest(epoch_us(first_at) - epoch_us(t), epoch_us(t) - epoch_us(last_at), 0) / 86400000000.0, 4) AS distance,
    round((greatest(epoch_us(last_at), epoch_us(t)) - least(epoch_us(first_at), epoch_us(t))) / 86400000000.0, 4) AS span
  FROM i JOIN c ON first_at <= t + INTERVAL 3 DAY AND last_at >= t - INTERVAL 3 DAY)
SELECT item_id, count(*) AS candidates, count(*) FILTER (distance > 0) AS adjacent, round(max(distance), 3) AS furthest FROM m WHERE span <= 7 GROUP BY item_id""")
def temporal_candidates(spark, sf_dir):
    items = read(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 20").select(F.col("event_id").alias("item_id"), F.col("ts").alias("at"))
    return clusters.temporal_counts(items, _weeks(spark, sf_dir), 3, 7).withColumn("furthest", F.round("furthest", 3))


_TEXTS = "SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type || ' ' || CAST(p_size % 10 AS VARCHAR) AS id FROM part"


@query(f"""
WITH t AS ({_TEXTS}), w AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(string_split(id, ' ')) AS word FROM t) GROUP BY ALL),
d AS (SELECT word, count(*) AS df FROM w GROUP BY word), x AS (SELECT id, word, tf * (ln(((SELECT count(*) FROM t) + 1) / (df + 1)) + 1) AS w FROM w JOIN d USING (word)),
v AS (SELECT id, word, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x)
SELECT p.id AS a, q.id AS b, round(sum(p.w * q.w), 6) AS cosine FROM v p JOIN v q ON p.word = q.word AND p.id < q.id GROUP BY ALL HAVING round(sum(p.w * q.w), 6) >= 0.8""")
def tfidf_pairs(spark, sf_dir):
    texts = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type", (F.col("p_size") % 10).cast("string")).alias("id")).distinct()
    return clusters.tfidf_pairs(texts, F.split("id", " "), 0.8)


@query("""
WITH m AS (SELECT l_orderkey AS item_id, l_partkey * 10 + l_linenumber AS cluster_id, l_returnflag <> 'A' AS same_event, CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE l_linenumber % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'followup' ELSE 'other' END AS relationship, max(l_discount) AS cosine FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE confidence WHEN 'high' THEN 1 ELSE 2 END, CASE relationship WHEN 'direct' THEN 1 WHEN 'followup' THEN 2 ELSE 99 END, cosine DESC, cluster_id) AS place
  FROM m WHERE same_event AND confidence <> 'low'),
s AS (SELECT item_id, bool_or(same_event) AS same FROM m GROUP BY item_id)
SELECT s.item_id, max(cluster_id) FILTER (place = 1) AS selected, CASE WHEN NOT same THEN 'no-same-event-match' WHEN count(place) = 0 THEN 'all-low-confidence' ELSE 'top-confidence-match' END AS reason,
  coalesce(string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY place) FILTER (place > 1), '') AS merge_candidates FROM s LEFT JOIN r USING (item_id) GROUP BY s.item_id, same""")
def selected_matches(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    words = lambda c, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (c % 3 + 1).cast("int"))
    matches = line.groupBy(
        F.col("l_orderkey").alias("item_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("cluster_id"), (F.col("l_returnflag") != "A").alias("same_event"),
        words(F.col("l_suppkey"), "high", "medium", "low").alias("confidence"), words(F.col("l_linenumber"), "direct", "followup", "other").alias("relationship"),
    ).agg(F.max("l_discount").alias("cosine"))
    out = clusters.selected_match(matches, ["direct", "followup"])
    return out.withColumn("merge_candidates", F.array_join(F.transform("merge_candidates", lambda x: x.cast("string")), ","))


@query("""
WITH m AS (SELECT l_partkey, count(*) FILTER (l_returnflag <> 'R') AS others, max(l_quantity) FILTER (l_returnflag = 'R') AS stars FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS cluster_id FROM part LEFT JOIN m ON p_partkey = l_partkey WHERE l_partkey IS NULL OR others > 20 OR stars >= 48""")
def repository_clusters(spark, sf_dir):
    """Clusters without members, with members from elsewhere, or with a repository of enough stars: three tests from one grouping."""
    flags = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("others"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("stars"))
    joined = read(spark, sf_dir, "part").join(flags, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.where(F.col("l_partkey").isNull() | (F.col("others") > 20) | (F.col("stars") >= 48)).select(F.col("p_partkey").alias("cluster_id"))


@query(f"""
WITH c AS ({_WEEKS}), s AS (SELECT user_id * 100 + week(ts) AS cluster_id, bool_or(event_type = 'click') AS clicked, max(ts) FILTER (value > 30) AS starred_at FROM events GROUP BY 1)
SELECT cluster_id, clicked, starred_at, last_at FROM s JOIN c USING (cluster_id) WHERE starred_at IS NOT NULL""")
def library_clusters(spark, sf_dir):
    key = (F.col("user_id") * 100 + F.weekofyear("ts")).alias("cluster_id")
    status = read(spark, sf_dir, "events").groupBy(key).agg(F.bool_or(F.col("event_type") == "click").alias("clicked"), F.max(F.when(F.col("value") > 30, F.col("ts"))).alias("starred_at"))
    return status.where("starred_at IS NOT NULL").join(_weeks(spark, sf_dir), "cluster_id").select("cluster_id", "clicked", "starred_at", "last_at")


@query("""
WITH d AS (SELECT l_orderkey, max(l_quantity) AS score, min(l_partkey) AS cluster_id FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey)
SELECT o_orderkey AS item_id, score, cluster_id, p_name AS title, CASE WHEN score IS NULL THEN 'unscored' WHEN p_partkey IS NULL THEN 'unclustered' ELSE 'ready' END AS state
FROM orders LEFT JOIN d ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = cluster_id AND p_size > 10 WHERE o_orderstatus = 'P'""")
def scoped_items(spark, sf_dir):
    """Items of a scope with their decision and cluster; what is missing stays null and names the state."""
    decisions = read(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.max("l_quantity").alias("score"), F.min("l_partkey").alias("cluster_id"))
    live = read(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", F.col("p_name").alias("title"))
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(decisions, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(live, F.col("cluster_id") == F.col("p_partkey"), "left")
    return rows.select(F.col("o_orderkey").alias("item_id"), "score", "cluster_id", "title", F.when(F.col("score").isNull(), "unscored").when(F.col("p_partkey").isNull(), "unclustered").otherwise("ready").alias("state"))


@query("""
WITH f AS (SELECT l_partkey, l_suppkey, min((l_shipdate, l_orderkey)) AS first FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY first, l_suppkey) AS place FROM f)
SELECT l_partkey AS cluster_id, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY place) AS sources FROM r WHERE place <= 3 GROUP BY l_partkey""")
def first_three_sources(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cluster_id"), F.col("l_suppkey").alias("source"), F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("item_id"))
    return clusters.first_sources(line).withColumn("sources", F.array_join(F.transform("sources", lambda s: s.cast("string")), ","))


@query("""
WITH m AS (SELECT l_partkey AS cluster_id, l_orderkey AS item_id, bool_or(l_returnflag = 'R') AS is_primary, max(l_shipdate) AS newest, min(l_linenumber) AS rank FROM lineitem GROUP BY ALL)
SELECT cluster_id, item_id, is_primary, row_number() OVER (PARTITION BY cluster_id ORDER BY is_primary DESC, newest DESC, rank, item_id) AS place FROM m
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY is_primary DESC, newest DESC, rank, item_id) <= 4""")
def newest_members(spark, sf_dir):
    members = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cluster_id"), F.col("l_orderkey").alias("item_id")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("is_primary"), F.max("l_shipdate").alias("at"), F.min("l_linenumber").alias("rank"))
    return clusters.newest_members(members, 4).select("cluster_id", "item_id", "is_primary", "place")


@query("""
WITH t AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS title, p_brand AS brand FROM part)
SELECT id, list_count(before) AS seen, list_count(list_filter(before, lambda b: b = brand)) AS same FROM (
  SELECT *, list(brand) OVER (ORDER BY title, id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS before FROM t) WHERE list_contains(before, brand)""")
def sliding_comparison(spark, sf_dir):
    """Each row against the 50 before it in order of title."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_brand").alias("brand"))
    seen = clusters.previous_rows(rows, "title", "id", 50, F.col("brand"), 500)
    same = F.size(F.filter("before", lambda b: b == F.col("brand")))
    return seen.where(same > 0).select("id", F.size("before").alias("seen"), same.alias("same"))


@query("""
WITH e AS (SELECT p_brand AS g, 'item-' || lpad(CAST(p_partkey * 7919 % 100003 AS VARCHAR), 8, 'abcdefgh') || '-' || p_partkey AS id, p_partkey AS k FROM part),
a AS (SELECT g, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN replace(id, 'item', 'itme') WHEN k % 7 = 0 THEN id || 'zzzz' ELSE id END AS id FROM e),
x AS (SELECT a.g, a.id, a.id AS answered FROM a JOIN e USING (g, id)), w AS (SELECT g, id FROM a WHERE id IS NOT NULL EXCEPT SELECT g, id FROM e), o AS (SELECT g, id FROM e EXCEPT SELECT g, id FROM a),
n AS (SELECT w.g, w.id AS answered, min(o.id) AS id FROM w JOIN o ON w.g = o.g AND levenshtein(o.id, w.id) <= 3 AND 1 - levenshtein(o.id, w.id) / greatest(length(o.id), length(w.id)) >= 0.85 GROUP BY ALL HAVING count(*) = 1)
SELECT g AS cluster, count(*) AS found, count(*) FILTER (id <> answered) AS repaired FROM (SELECT g, id, answered FROM x UNION ALL SELECT g, id, answered FROM n) GROUP BY g""")
def response_closure(spark, sf_dir):
    """Which expected ids an answer covers, with small slips put right."""
    key = F.col("p_partkey")
    made = F.concat(F.lit("item-"), F.lpad((key * 7919 % 100003).cast("string"), 8, "abcdefgh"), F.lit("-"), key.cast("string"))
    expected = read(spark, sf_dir, "part").select(F.col("p_brand").alias("group"), made.alias("id"), key.alias("k"))
    given = F.when(F.col("k") % 5 == 0, None).when(F.col("k") % 3 == 0, F.regexp_replace("id", "item", "itme")).when(F.col("k") % 7 == 0, F.concat("id", F.lit("zzzz"))).otherwise(F.col("id"))
    answered = expected.select("group", given.alias("id")).where("id is not null")
    found = clusters.repaired_ids(answered, expected.drop("k"), 3, 0.85)
    return found.groupBy(F.col("group").alias("cluster")).agg(F.count("*").alias("found"), F.count_if(F.col("id") != F.col("answered")).alias("repaired"))


@query("""
WITH p AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS certainty, l_returnflag AS category, CAST(l_suppkey % 5 AS VARCHAR) AS sub FROM lineitem)
SELECT l_orderkey AS cluster_id, arg_min(certainty, list_position(['low', 'medium', 'high'], certainty)) AS certainty,
  (SELECT category FROM p q WHERE q.l_orderkey = p.l_orderkey GROUP BY category ORDER BY count(*) DESC, category LIMIT 1) AS category, string_agg(DISTINCT sub, ',' ORDER BY sub) AS subcategories FROM p GROUP BY l_orderkey""")
def merged_decisions(spark, sf_dir):
    names = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    parts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), names.alias("certainty"), F.col("l_returnflag").alias("category"), (F.col("l_suppkey") % 5).cast("string").alias("subcategory"))
    return clusters.merged_decisions(parts, ["low", "medium", "high"]).withColumn("subcategories", F.array_join("subcategories", ","))


@query("""
WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_partkey // 6 END AS merged_into, p_partkey % 13 = 0 AS archived, p_partkey % 17 = 0 AS removed FROM part)
SELECT coalesce(c.merged_into, c.id) AS cluster_id, count(*) AS members, count(DISTINCT l_suppkey) AS sources FROM lineitem JOIN c ON l_partkey = c.id WHERE NOT removed AND NOT archived GROUP BY 1""")
def redirected_clusters(spark, sf_dir):
    """Members of live clusters, counted under the cluster that theirs was merged into."""
    key = F.col("p_partkey")
    live = read(spark, sf_dir, "part").where((key % 13 != 0) & (key % 17 != 0)).select(key, F.when(key % 6 == 0, F.floor(key / 6)).alias("merged_into"))
    joined = read(spark, sf_dir, "lineitem").join(live, F.col("l_partkey") == key)
    return joined.groupBy(F.coalesce("merged_into", "p_partkey").alias("cluster_id")).agg(F.count("*").alias("members"), F.countDistinct("l_suppkey").alias("sources"))


@query("""
WITH m AS (SELECT l_partkey, l_suppkey, l_shipdate, l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || l_orderkey END AS cover FROM lineitem WHERE l_linestatus = 'F')
SELECT p_partkey AS cluster_id, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at, count(l_suppkey) AS members, arg_min(cover, (l_shipdate, l_orderkey, cover)) FILTER (cover IS NOT NULL) AS cover,
  CASE WHEN count(l_suppkey) = 0 THEN 'empty' WHEN count(l_suppkey) <> p_size THEN 'mismatch' ELSE 'clean' END AS state FROM part LEFT JOIN m ON p_partkey = l_partkey GROUP BY p_partkey, p_size""")
def materialised_clusters(spark, sf_dir):
    """Clusters with their members' time bounds and first cover, and whether the stored count agrees."""
    cover = F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_returnflag", F.col("l_orderkey").cast("string")))
    m = read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy("l_partkey").agg(
        F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"), F.count("*").alias("members"), F.min(F.when(cover.isNotNull(), F.struct("l_shipdate", "l_orderkey", cover.alias("cover"))))["cover"].alias("cover"))
    n = F.coalesce("members", F.lit(0))
    return read(spark, sf_dir, "part").join(m, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("cluster_id"), "first_at", "last_at", n.alias("members"), "cover", F.when(n == 0, "empty").when(n != F.col("p_size"), "mismatch").otherwise("clean").alias("state"))


_EVENT = """SELECT l_orderkey, CASE WHEN min(l_linenumber) = 1 THEN 'Event' ELSE ' ' END AS title, max(l_returnflag) AS summary, count(DISTINCT l_suppkey) AS sources,
  CASE min(l_partkey) % 4 WHEN 0 THEN 'Coding' WHEN 1 THEN 'other' WHEN 2 THEN 'fun' ELSE 'models' END AS category, CASE WHEN min(l_suppkey) % 5 = 0 THEN 'LOW ' ELSE 'high' END AS certainty,
  CASE WHEN max(l_quantity) > 49 THEN 'unrelated members' WHEN max(l_quantity) > 47 THEN 'stock rally' WHEN max(l_quantity) > 45 THEN 'stock rally after funding' ELSE 'fine' END AS warning FROM lineitem GROUP BY l_orderkey"""


@query(f"""
WITH e AS ({_EVENT})
SELECT l_orderkey AS cluster_id FROM e WHERE trim(title) <> '' AND trim(summary) <> '' AND lower(trim(category)) <> 'other' AND lower(trim(certainty)) <> 'low' AND NOT contains(warning, 'unrelated')
  AND NOT (contains(warning, 'stock') AND NOT contains(warning, 'funding')) AND (sources >= 2 OR lower(category) IN ('coding', 'models'))""")
def displayable_events(spark, sf_dir):
    one = F.min("l_partkey") % 4
    most = F.max("l_quantity")
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.when(F.min("l_linenumber") == 1, "Event").otherwise(" ").alias("title"), F.max("l_returnflag").alias("summary"), F.countDistinct("l_suppkey").alias("sources"),
        F.when(one == 0, "Coding").when(one == 1, "other").when(one == 2, "fun").otherwise("models").alias("category"), F.when(F.min("l_suppkey") % 5 == 0, "LOW ").otherwise("high").alias("certainty"),
        F.when(most > 49, "unrelated members").when(most > 47, "stock rally").when(most > 45, "stock rally after funding").otherwise("fine").alias("warning"))
    shown = clusters.displayable(*[F.col(c) for c in ("title", "summary", "sources", "category", "certainty")], F.array("warning"), ["unrelated"], ["stock"], ["funding"])
    return rows.where(shown).select(F.col("l_orderkey").alias("cluster_id"))


@query("""
WITH i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN 'why' END AS why_read, o_totalprice / 50000 AS score, CASE o_orderkey % 29 WHEN 0 THEN 'force_hide' WHEN 1 THEN 'force_show' END AS override FROM orders)
SELECT o_orderkey AS item_id, coalesce(override, '') <> 'force_hide' AND (coalesce(override, '') = 'force_show' OR why_read IS NOT NULL AND score >= 6) AS shown, coalesce(override, '') <> 'force_hide' AS shown_open FROM i""")
def highlights_gate(spark, sf_dir):
    key = F.col("o_orderkey")
    why, score, forced = F.when(key % 4 > 0, "why"), F.col("o_totalprice") / 50000, F.when(key % 29 == 0, "force_hide").when(key % 29 == 1, "force_show")
    return read(spark, sf_dir, "orders").select(key.alias("item_id"), clusters.highlighted(why, score, forced, 6).alias("shown"), clusters.highlighted(why, score, forced, None).alias("shown_open"))


@query("""
SELECT lang, count(*) FILTER (meta) AS metadata, count(*) AS n FROM (SELECT lang, trim(t) = '' OR contains(t, 'license')::INT + contains(t, 'http')::INT + contains(t, '@')::INT >= 2
  OR length(trim(t)) < 180 AND regexp_matches(t, 'https?://') AS meta FROM (SELECT lang, lower(text) AS t FROM documents)) GROUP BY lang""")
def metadata_texts(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(clusters.looks_like_metadata(F.col("text"), ["license", "http", "@"])).alias("metadata"), F.count("*").alias("n"))


@query("""
WITH i AS (SELECT round(l_extendedprice / 10000, 1) AS score, l_quantity > 25 AS wanted FROM lineitem), t AS (SELECT range / 2.0 AS threshold FROM range(0, 20)),
s AS (SELECT threshold, avg((score >= threshold)::INT) FILTER (wanted) AS keeps, avg((score < threshold)::INT) FILTER (NOT wanted) AS stops FROM i, t GROUP BY threshold)
SELECT threshold, round(keeps, 4) AS retention, round(stops, 4) AS interception, keeps >= 0.6 AND stops >= 0.6 AS meets FROM s""")
def gate_scan(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice") / 10000, 1).alias("score"), (F.col("l_quantity") > 25).alias("wanted"))
    return clusters.gate_scan(items, [t / 2 for t in range(20)], 0.6, 0.6)


@query("""
WITH i AS (SELECT round(l_extendedprice / 10000, 1) AS score, l_quantity > 25 AS wanted FROM lineitem), t AS (SELECT range / 2.0 AS threshold FROM range(0, 20)),
s AS (SELECT threshold, avg((score >= threshold)::INT) FILTER (wanted) AS keeps, avg((score < threshold)::INT) FILTER (NOT wanted) AS stops FROM i, t GROUP BY threshold)
SELECT g.need, CASE WHEN bool_or(keeps >= need AND stops >= need) THEN max(threshold) FILTER (keeps >= need AND stops >= need) ELSE arg_max(threshold, (round(keeps, 4) + round(stops, 4), threshold)) END AS threshold,
  bool_or(keeps >= need AND stops >= need) AS feasible FROM s, (VALUES (0.6), (0.95)) g(need) GROUP BY g.need""")
def best_gates(spark, sf_dir):
    """The threshold chosen where some meet the gate, and where none does."""
    items = read(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice") / 10000, 1).alias("score"), (F.col("l_quantity") > 25).alias("wanted"))
    one = lambda need: clusters.best_gate(clusters.gate_scan(items, [t / 2 for t in range(20)], need, need)).withColumn("need", F.lit(need))
    return one(0.6).unionByName(one(0.95))


@query("""
WITH g AS (SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, l_linenumber)) AS chosen, arg_max(l_linenumber, (l_quantity, l_linenumber)) AS human, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT n, count(*) AS groups, count(*) FILTER (chosen = human) AS agreed, round(avg((chosen = human)::INT), 4) AS agreement FROM g WHERE n > 1 GROUP BY n""")
def preference_agreement(spark, sf_dir):
    """How often the best score of a group is the winner that people chose."""
    line = F.col("l_linenumber")
    groups = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max_by(line, F.struct("l_extendedprice", "l_linenumber")).alias("chosen"), F.max_by(line, F.struct("l_quantity", "l_linenumber")).alias("human"), F.count("*").alias("n"))
    agreed = F.col("chosen") == F.col("human")
    return groups.where("n > 1").groupBy("n").agg(F.count("*").alias("groups"), F.count_if(agreed).alias("agreed"), F.round(F.avg(agreed.cast("int")), 4).alias("agreement"))


@query("""
WITH p AS (SELECT l_orderkey, max(l_quantity) AS score FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey)
SELECT o_orderkey AS case_id, CASE WHEN score IS NULL THEN 'error' WHEN (score >= 40) = (o_orderstatus = 'F') THEN 'pass' ELSE 'fail' END AS outcome FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def golden_replay(spark, sf_dir):
    """Cases against what is predicted now; a case without a prediction is an error."""
    predicted = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").groupBy("l_orderkey").agg(F.max("l_quantity").alias("score"))
    joined = read(spark, sf_dir, "orders").join(predicted, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    right = (F.col("score") >= 40) == (F.col("o_orderstatus") == "F")
    return joined.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("score").isNull(), "error").when(right, "pass").otherwise("fail").alias("outcome"))


@query("""
WITH i AS (SELECT o_orderkey AS k, o_totalprice AS score, min(l_partkey) AS cluster_id, max(l_quantity) AS q FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT k AS item_id, CASE WHEN k % 10 = 0 THEN 'scoring' WHEN cluster_id IS NULL THEN 'clustering' WHEN cluster_id % 7 = 0 OR q < 20 THEN 'summary' WHEN score < 100000 OR k % 3 = 0 THEN 'display' ELSE 'displayed' END AS stage FROM i""")
def stage_attribution(spark, sf_dir):
    """The first stage that an item does not get through."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("cluster_id"), F.max("l_quantity").alias("q"))
    rows = read(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, cluster = F.col("o_orderkey"), F.col("cluster_id")
    gates = [("scoring", key % 10 == 0), ("clustering", cluster.isNull()), ("summary", (cluster % 7 == 0) | (F.col("q") < 20)), ("display", (F.col("o_totalprice") < 100000) | (key % 3 == 0))]
    return rows.select(key.alias("item_id"), clusters.first_failing(gates, "displayed").alias("stage"))
