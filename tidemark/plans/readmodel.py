"""A read model kept up to date from shards of changes."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..operators import readmodel
from ..sources.versions import VersionedTables
from ..streaming.jobs import shared_dir
from .registry import query, read

BEGIN = datetime(2024, 1, 1)


def changes(spark, sf_dir):
    """Documents as they come in over four days; those with a label are changed later: toxic ones go, the others get a category
    by quality."""
    hour = lambda h: F.lit(BEGIN) + F.make_interval(hours=h.cast("int"))
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    shape = lambda category, at, deleted: [
        F.col("doc_id").alias("item_id"), F.concat(F.lit("p"), F.col("doc_id") % 5).alias("platform"), "source", category.alias("category"),
        F.array(F.concat(F.lit("s"), F.col("doc_id") % 3), F.concat(F.lit("n"), F.col("n_chars") % 4)).alias("subcategories"),
        hour(F.col("doc_id") % 1000).cast("timestamp").alias("rank_at"), deleted.alias("deleted"), at.cast("timestamp").alias("changed_at")]
    first = docs.select(*shape(F.col("lang"), hour(F.col("doc_id") % 96 + 1), F.lit(False)))
    once = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    later = docs.join(once, "doc_id").select(*shape(F.concat(F.lit("q"), F.col("quality")), hour(F.col("doc_id") % 96 + 25), F.col("toxic") == 1))
    return first.unionByName(later)


@query("""
WITH once AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
cards AS (
  SELECT d.doc_id, 'p' || d.doc_id % 5 AS platform, source, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'q' || l.quality END AS category, 's' || d.doc_id % 3 AS s1, 'n' || n_chars % 4 AS s2,
    TIMESTAMP '2024-01-01' + to_hours((d.doc_id % 1000)::INT) AS rank_at
  FROM documents d LEFT JOIN once l ON l.doc_id = d.doc_id WHERE l.toxic IS NULL OR l.toxic <> 1),
s AS (
  SELECT '_all' AS platform, 'all' AS dimension, '' AS value, rank_at FROM cards UNION ALL SELECT platform, 'all', '', rank_at FROM cards
  UNION ALL SELECT platform, 'source', source, rank_at FROM cards UNION ALL SELECT platform, 'category', category, rank_at FROM cards
  UNION ALL SELECT '_all', 'section_category', category, rank_at FROM cards
  UNION ALL SELECT '_all', 'section_subcategory', category || chr(31) || unnest([s1, s2]), rank_at FROM cards)
SELECT platform, dimension, value, count(*) AS total_count, max(rank_at) AS max_rank_at FROM s WHERE value IS NOT NULL GROUP BY ALL""")
def scope_read_model(spark, sf_dir):
    """The roll-up after shards of two days; each works only on what it affects."""
    model = readmodel.ReadModel(VersionedTables(spark, f"{shared_dir(spark)}/readmodel-{uuid.uuid4().hex}"))
    for _ in model.catch_up(changes(spark, sf_dir), BEGIN, BEGIN + timedelta(hours=130), timedelta(hours=48)):
        pass
    return model.scopes().withColumn("max_rank_at", F.col("max_rank_at").cast("timestamp_ntz"))
