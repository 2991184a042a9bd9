"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, texts, times, vectors
from .registry import query, read


@query("""
WITH i AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'twitter' WHEN 1 THEN 'bilibili' WHEN 2 THEN 'github' WHEN 3 THEN 'rss' ELSE 'none' END AS platform, value, user_id,
  CASE WHEN event_type <> 'error' THEN epoch(TIMESTAMP '2024-02-01' - ts) / 3600 END AS hours FROM events),
e AS (SELECT *, CASE platform WHEN 'twitter' THEN value + 2 * user_id WHEN 'bilibili' THEN value + 3 * user_id WHEN 'github' THEN value WHEN 'rss' THEN value + user_id ELSE 0 END AS engagement FROM i)
SELECT event_id, round(engagement, 4) AS engagement, round(10 * (user_id % 3) + 2 * ln(1 + engagement), 2) AS relevance, round(coalesce(pow(0.5, hours / 48), 1.0), 4) AS factor FROM e""")
def item_scores(spark, sf_dir):
    e, kind = read(spark, sf_dir, "events"), F.col("event_id") % 5
    platform = F.when(kind == 0, "twitter").when(kind == 1, "bilibili").when(kind == 2, "github").when(kind == 3, "rss").otherwise("none")
    user, value = F.col("user_id").cast("double"), F.col("value")
    pairs = lambda **m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v)])
    metrics = F.when(kind == 0, pairs(likes=value, retweets=user)).when(kind == 1, pairs(likes=value, coins=user)).when(kind == 2, pairs(stargazers_count=value)).when(kind == 3, pairs(a=value, b=user, c=-user))
    rows = e.select("event_id", "user_id", scores.engagement(platform, metrics).alias("engagement"), F.when(F.col("event_type") != "error", times.age_hours(F.col("ts"), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")))).alias("hours"))
    return rows.select("event_id", F.round("engagement", 4).alias("engagement"), scores.relevance(F.col("user_id") % 3, F.col("engagement")).alias("relevance"), scores.time_factor(F.col("hours"), F.lit(48.0)).alias("factor"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, 1 + l_partkey % 3 AS substance, 1 + l_suppkey % 3 AS actionability, 1 + l_orderkey % 3 AS novelty, 1 + l_linenumber % 3 AS spam, 1 + CAST(l_quantity AS BIGINT) % 3 AS credibility,
  1 + (l_partkey // 3) % 3 AS importance, l_tax > 0.06 AS edge, CASE WHEN l_discount > 0.08 THEN 'no' ELSE 'yes' END AS relevant FROM lineitem),
p AS (SELECT *, (substance = 3 AND NOT edge OR actionability = 3 OR novelty = 3) OR (substance >= 2)::INT + (actionability >= 2)::INT + (novelty >= 2)::INT >= 3 AS path FROM d)
SELECT CASE WHEN relevant = 'no' OR spam >= 3 THEN 'drop' WHEN path AND credibility >= 2 THEN 'featured' WHEN importance = 1 AND substance = 1 AND actionability = 1 AND novelty = 1 OR credibility = 1 AND NOT path THEN 'drop' ELSE 'review' END AS verdict,
  spam, credibility, count(*) AS n FROM p GROUP BY ALL""")
def item_verdicts(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    values = {"substance": 1 + F.col("l_partkey") % 3, "actionability": 1 + F.col("l_suppkey") % 3, "novelty": 1 + F.col("l_orderkey") % 3}
    spam, cred = 1 + F.col("l_linenumber") % 3, 1 + F.col("l_quantity").cast("long") % 3
    edge = F.when(F.col("l_tax") > 0.06, F.array(F.lit("substance"))).otherwise(F.array().cast("array<string>"))
    verdict = scores.item_verdict(F.when(F.col("l_discount") > 0.08, "no").otherwise("yes"), spam, cred, 1 + F.floor(F.col("l_partkey") / 3) % 3, values, edge)
    return line.groupBy(verdict.alias("verdict"), spam.alias("spam"), cred.alias("credibility")).agg(F.count("*").alias("n"))


@query(r"""
WITH t AS (SELECT doc_id, substr(text, 1, 300) AS body, CASE doc_id % 4 WHEN 0 THEN '[pinned] 【公告】 ' || source WHEN 1 THEN source || ' [late]' WHEN 2 THEN '中文标题' || lang ELSE '今天发布新的模型2' END AS title FROM documents)
SELECT doc_id, len(regexp_extract_all('**' || replace(body, ' ', '** **') || '**', '\*\*[^*\n]+\*\*')) AS bold, doc_id % 4 = 3 AS chinese,
  CASE doc_id % 4 WHEN 0 THEN (SELECT source FROM documents d WHERE d.doc_id = t.doc_id) ELSE title END AS title FROM t""")
def text_marks(spark, sf_dir):
    d, kind = read(spark, sf_dir, "documents"), F.col("doc_id") % 4
    title = F.when(kind == 0, F.concat(F.lit("[pinned] 【公告】 "), "source")).when(kind == 1, F.concat("source", F.lit(" [late]"))).when(kind == 2, F.concat(F.lit("中文标题"), "lang")).otherwise("今天发布新的模型2")
    marked = F.concat(F.lit("**"), F.replace(F.substring("text", 1, 300), F.lit(" "), F.lit("** **")), F.lit("**"))
    return d.select("doc_id", texts.bold_spans(marked).alias("bold"), texts.mostly_chinese(title).alias("chinese"), texts.clean_title(title).alias("title"))


@query("""
WITH w AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, role FROM conversations)
SELECT conv_id, string_agg(role, '|' ORDER BY first) AS steps FROM (SELECT conv_id, role, min(place) AS first FROM w GROUP BY ALL) GROUP BY conv_id""")
def action_steps(spark, sf_dir):
    """Lists with bullets and numbers of several kinds, read as steps."""
    line = F.concat(F.element_at(F.array(F.lit("- "), F.lit("* "), F.lit("1. "), F.lit("2) "), F.lit("  • ")), (F.col("turn") % 5 + 1).cast("int")), "role", F.lit("  "))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda r: r["line"])
    made = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(rows, "\n\n").alias("prompt"))
    return made.select("conv_id", F.array_join(texts.steps(F.col("prompt")), "|").alias("steps"))


@query("""
WITH u AS (SELECT user_id, min(ts) AS since, max(ts) AS until FROM events GROUP BY user_id),
e AS (SELECT user_id, since, until, unnest(list_concat([until], list_filter(list_transform(range(0, 40), lambda k: date_trunc('day', until) - INTERVAL 2 DAY - INTERVAL 3 DAY * k), lambda t: t > since), [since])) AS edge FROM u WHERE since < until)
SELECT user_id, lead(edge) OVER (PARTITION BY user_id ORDER BY edge DESC) AS start_at, edge AS end_at FROM e QUALIFY lead(edge) OVER (PARTITION BY user_id ORDER BY edge DESC) IS NOT NULL""")
def processing_windows(spark, sf_dir):
    """Each user's time cut into windows of three days, from the newest back, at midnight."""
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("since"), F.max("ts").alias("until"))
    w = u.select("user_id", F.explode(times.day_windows(F.col("since"), F.col("until"), 3)).alias("w"))
    return w.select("user_id", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"))


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3 + 1) / n)), 5) AS total, 1.0 AS length
FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3 + 1) * (x::DOUBLE * 3 + 1)))) AS n FROM embeddings)""")
def unit_vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", vectors.normalised(F.transform("embedding", lambda x: x.cast("double") * 3 + 1)).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(vectors.norm(F.col("v")), 6).alias("length"))
