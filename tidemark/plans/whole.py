"""Whole-table forms of queries that are registered over fixed subsets: the same operators without the filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import evaluation, merges, tiles
from ..sources import payloads
from .content import _COS, TENTHS
from .registry import query, read


@query(f"""
SELECT a.vec_id AS q, b.vec_id AS s, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0
WHERE {_COS} >= 0.2 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.vec_id) <= 5""")
def topk_recall_whole(spark, sf_dir):
    vec = read(spark, sf_dir, "embeddings")
    return tiles.top_k(vec.where("vec_id % 20 = 0"), vec, 5, 0.2, "vec_id", "embedding").select("q", "s", F.round("cosine", 6).alias("cosine"))


@query(f"""
SELECT label, floor(c * 10) / 10 AS bin, count(*) AS n FROM (SELECT a.label, {_COS} AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label) WHERE c >= 0.2 GROUP BY ALL""")
def cosine_histogram_whole(spark, sf_dir):
    found = tiles.counts(read(spark, sf_dir, "embeddings"), TENTHS, "vec_id", "embedding", group="label")
    return found.select(F.col("mark").cast("int").alias("label"), ((F.col("bin") + 2) / 10).alias("bin"), "n")


@query("""
WITH hits AS (SELECT user_id, event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND (event_type = 'view' OR event_type = 'click' AND value > 50) GROUP BY ALL)
SELECT c_custkey AS user_id, count(event_id) AS items, max(ts) AS last_at,
  CASE WHEN max(ts) IS NULL OR epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600 >= 72 THEN 'crit' WHEN epoch(TIMESTAMP '2024-02-01' - max(ts)) / 3600 >= 24 THEN 'warn' ELSE 'ok' END AS level
FROM customer LEFT JOIN hits ON c_custkey = user_id GROUP BY c_custkey""")
def source_health_7d_whole(spark, sf_dir):
    recent = read(spark, sf_dir, "events").where(F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-24 00:00:00"))).select("user_id", "event_id", "ts", "event_type", "value")
    hits = recent.where("event_type = 'view'").unionByName(recent.where("event_type = 'click' AND value > 50")).select("user_id", "event_id", "ts").distinct()
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    health = users.join(hits, "user_id", "left").groupBy("user_id").agg(F.count("event_id").alias("items"), F.max("ts").alias("last_at"))
    return health.withColumn("level", times.freshness_level(times.age_hours(F.col("last_at"), F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")))))


@query("""
WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def correlations_whole(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")

    both = rows.join(evaluation.average_ranks(rows, "l_quantity", "r_l_quantity"), "l_quantity").join(evaluation.average_ranks(rows, "l_extendedprice", "r_l_extendedprice"), "l_extendedprice")
    return both.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"), F.round(F.corr("r_l_quantity", "r_l_extendedprice"), 6).alias("spearman"))


@query("""
SELECT 'hn_' || event_id AS item_id, 'hackernews' AS platform, event_type AS title, value AS score, date_trunc('second', ts) AS published_at FROM events""")
def source_items_whole(spark, sf_dir):
    made = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("value").alias("score"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time")))
    items = payloads.hackernews(read(spark, sf_dir, "events").select(made.alias("payload")))
    return items.select("item_id", "platform", "title", F.element_at("metrics", F.lit("score")).alias("score"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("""
WITH batch AS (SELECT doc_id, lang, source, text FROM documents WHERE doc_id % 3 = 0),
stored AS (SELECT doc_id, lang, source, text FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(s.doc_id, b.doc_id) AS item_id, coalesce(s.lang, b.lang) AS lang,
  CASE WHEN length(coalesce(b.text, '')) > length(coalesce(s.text, '')) THEN b.text ELSE s.text END AS content,
  coalesce(nullif(CASE WHEN b.doc_id IS NOT NULL AND b.doc_id % 5 = 0 THEN '' ELSE 'new:' || b.source END, ''), 'old:' || s.source) AS author,
  CASE WHEN b.doc_id IS NOT NULL THEN 2 ELSE 1 END AS metrics, s.doc_id IS NULL AS was_inserted
FROM stored s FULL JOIN batch b ON s.doc_id = b.doc_id""")
def upsert_fold_whole(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    shape = lambda df, mark, metrics: df.select(
        F.col("doc_id").alias("item_id"), F.lit("t").alias("title"), "lang", F.col("text").alias("content"), F.lit("u").alias("url"),
        F.when((F.lit(mark) == "new:") & (F.col("doc_id") % 5 == 0), "").otherwise(F.concat(F.lit(mark), "source")).alias("author"),
        F.lit(None).cast("string").alias("summary"), F.lit(metrics).alias("metrics"))
    folded = merges.upsert_items(shape(docs.where("doc_id % 2 = 0"), "old:", 1), shape(docs.where("doc_id % 3 = 0"), "new:", 2))
    return folded.select("item_id", "lang", "content", "author", "metrics", "was_inserted")
