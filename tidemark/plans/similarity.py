"""Recall of the nearest vectors and clustering batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events, incremental, tiles
from ..streaming.jobs import shared_dir
from .content import _COS
from .registry import query, read


@query(f"""
WITH found AS (SELECT a.vec_id AS q, b.vec_id AS s, {_COS} AS c, a.label = b.label AS same FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
best AS (SELECT * FROM found WHERE c >= 0.65 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, s) <= 10)
SELECT q, s, round(c, 6) AS cosine, CASE WHEN c >= 0.75 THEN 'strong' WHEN c >= 0.70 THEN CASE WHEN same THEN 'gray' ELSE 'rejected' END ELSE 'shadow' END AS band FROM best""")
def recall_candidates(spark, sf_dir):
    """The ten nearest stored vectors of every twentieth one, in bands; gray ones pass only with a label in common."""
    vec = read(spark, sf_dir, "embeddings")
    # a query finds itself too, if not behind as many copies: one more is asked for, and the ten best others stay
    found = tiles.top_k(vec.where("vec_id % 20 = 0"), vec, 11, events.SHADOW, "vec_id", "embedding").where("q <> s")
    order = Window.partitionBy("q").orderBy("rank")
    best = found.withColumn("place", F.row_number().over(order)).where("place <= 10")
    label = lambda side, name: vec.select(F.col("vec_id").alias(side), F.col("label").alias(name))
    both = best.join(label("q", "lq"), "q").join(label("s", "ls"), "s")
    same = F.coalesce(F.col("lq") == F.col("ls"), F.lit(False))
    band = F.when((F.col("cosine") >= events.GRAY) & (F.col("cosine") < events.STRONG) & ~same, "rejected").otherwise(events.band(F.col("cosine")))
    return both.select("q", "s", F.round("cosine", 6).alias("cosine"), band.alias("band"))


def timed_items(spark, sf_dir):
    """Vectors as items of a month of hours, with an author, a category and entities."""
    hour = F.col("vec_id") * 7919 % 744
    t = F.lit(1704067200000000) + hour * incremental.HOUR
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.slice("embedding", 1, 24).alias("v"), t.alias("t"), F.concat(F.lit("u"), F.col("vec_id") % 7).alias("author"),
        F.col("label").cast("string").alias("category"), F.array(F.concat(F.lit("e"), F.col("vec_id") % 3), F.concat(F.lit("f"), F.col("label"))).alias("entities"), hour.alias("hour"))


@query()
def incremental_clusters(spark, sf_dir):
    """Order dependent: three batches in order of time, each going on from the clusters of those before it."""
    items, folder = timed_items(spark, sf_dir), f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    for n in range(3):
        incremental.assign_batch(items.where((F.col("hour") >= 248 * n) & (F.col("hour") < 248 * (n + 1))).drop("hour"), folder, n)
    return incremental.assignments(spark, folder).select("id", "cluster", "founded", "band", F.round("cosine", 6).alias("cosine"))
