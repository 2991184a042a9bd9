"""Upserts, versions and integrity of stored items. Tables are rewritten, never changed in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: Sequence) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert_items(old: DataFrame, new: DataFrame, key: str = "item_id") -> DataFrame:
    """Longer content stays, new urls and authors win unless empty, summaries fill gaps, metrics are replaced, titles
    and languages never change. Columns: key, title, lang, content, url, author, summary, metrics; was_inserted tells
    new rows."""
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in new.columns if c != key], F.lit(True).alias("_new"))
    o = old.withColumn("_old", F.lit(True))
    both = o.join(n, key, "full_outer")
    fresh = F.col("_old").isNull()
    keep = lambda c: F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    filled = lambda c: F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit("")), F.col(c)).alias(c)
    longer = F.when(F.length(F.coalesce("n_content", F.lit(""))) > F.length(F.coalesce("content", F.lit(""))), F.col("n_content")).otherwise(F.col("content"))
    return both.select(
        key, keep("title"), keep("lang"), longer.alias("content"), filled("url"), filled("author"),
        F.coalesce("summary", "n_summary").alias("summary"),
        F.when(F.col("_new"), F.col("n_metrics")).otherwise(F.col("metrics")).alias("metrics"), fresh.alias("was_inserted"),
    )


def registry_gate(items: DataFrame, sources: DataFrame, closed: Sequence[str] = ("paused", "deleted", "broken")) -> DataFrame:
    """Items with their source's id; those of closed sources go, those of unknown ones stay without an id."""
    known = sources.select(F.col("source_id"), F.col("source_key").alias("source"), "status")
    return items.join(known, "source", "left").where(F.col("status").isNull() | ~F.col("status").isin(list(closed))).drop("status")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def publish(live: DataFrame, drafts: DataFrame, key: str) -> DataFrame:
    """Live rows with their drafts' values where there are any; a draft raises the version by one."""
    d = drafts.select(key, *[F.col(c).alias(f"d_{c}") for c in drafts.columns if c != key], F.lit(1).alias("_draft"))
    both = live.join(d, key, "left")
    values = [F.coalesce(F.col(f"d_{c}"), F.col(c)).alias(c) for c in drafts.columns if c != key]
    return both.select(key, *values, (F.col("version") + F.coalesce("_draft", F.lit(0))).alias("version"))


def keyed_merge(old: DataFrame, new: DataFrame, key: str, rank: str) -> DataFrame:
    """A new row replaces an old one of its key only if its rank is no lower."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return first_per_key(both, key, [F.desc(rank), F.desc("_side")]).drop("_side")
