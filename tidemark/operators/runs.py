"""Fetch runs: what belongs to a run, what is still to do, what went stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_run(items: DataFrame, run_items: DataFrame, inserted_only: bool = False) -> DataFrame:
    """Items that a run touched, or those that it inserted."""
    touched = run_items.where("was_inserted") if inserted_only else run_items
    return items.join(touched.select("item_id"), "item_id", "left_semi")


def outside_run(items: DataFrame, run_items: DataFrame, inserted_only: bool = False) -> DataFrame:
    touched = run_items.where("was_inserted") if inserted_only else run_items
    return items.join(touched.select("item_id"), "item_id", "left_anti")


def new_items(runs: DataFrame, items: DataFrame, run_items: DataFrame) -> DataFrame:
    """(run_id, item_id): what each run inserted; for runs that recorded nothing, items created between its bounds.

    The bounds are met day by day: a run is listed under each day that it spans, an item under its own.
    """
    recorded = run_items.where("was_inserted").select("run_id", "item_id")
    silent = runs.join(run_items.select("run_id").distinct(), "run_id", "left_anti")
    days = silent.withColumn("day", F.explode(F.sequence(F.to_date("started_at"), F.to_date("finished_at"))))
    dated = items.withColumn("day", F.to_date("created_at"))
    between = F.col("created_at").between(F.col("started_at"), F.col("finished_at"))
    return recorded.unionByName(days.join(dated, "day").where(between).select("run_id", "item_id")).distinct()


def pending(needs: dict[str, Column]) -> list[Column]:
    """Counts of rows by what they still need; a row may need several things."""
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in needs.items()]


def stale(started: Column, heartbeat: Column, now: Column, hours: float) -> Column:
    """A run that has not ended and gave no sign of life for so long."""
    last = F.coalesce(heartbeat, started)
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp")) > int(hours * 3_600_000_000)


def kept_keys(counts: Column, disabled: list[str]) -> Column:
    """A map without the keys of disabled platforms."""
    return F.map_filter(counts, lambda k, _: ~k.isin(*disabled))


def merged_counters(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Upsert of (key, score, is_new, hits): the last score wins, a stored ``is_new`` stays, hits add up."""
    s, b = stored.alias("s"), batch.alias("b")
    return s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full").select(
        F.coalesce(f"s.{key}", f"b.{key}").alias(key), F.coalesce("b.score", "s.score").alias("score"), F.coalesce("s.is_new", "b.is_new").alias("is_new"),
        (F.coalesce("s.hits", F.lit(0)) + F.coalesce("b.hits", F.lit(0))).alias("hits"),
    )
