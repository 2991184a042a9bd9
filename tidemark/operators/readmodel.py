"""The read model of a feed: counts and newest rank of every scope, kept up to date from deltas.

A scope is a platform (or all), a dimension and a value: all items, a source, a category, a category with a subcategory.
Three tables are kept in versions. ``cards`` hold the items, in buckets by item. ``parts`` hold, for each bucket of cards, the
count and newest rank of every scope within it. ``scopes`` hold the roll-up of the parts, in buckets by scope.

A delta touches the buckets of its items: their cards and parts are written again. The scopes it affects are those that its
items were in before together with those that they are in now, and only these are rolled up again, from parts, so that a
scope that holds every item is still summed over buckets and not over items. Buckets that nothing affects keep their files.

Changes come in shards of at most ``window`` that end at ``min(start + window, now)``; each shard and its watermark are
committed as one version, so a run that dies goes on behind the last shard that was whole.

Nulls: a null platform, source or category gives no scope of its own, and the item counts in the wider ones. A null rank counts
but is no one's newest. Changes without item_id or time are left out. Of several changes to an item the last one counts,
ties by the larger rank, deletions first.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import discard, keep
from ..sources.versions import Version, VersionedTables, bucket_of

ITEM_BUCKETS, SCOPE_BUCKETS = 32, 16
#: Between a category and its subcategory.
WITHIN = "\x1f"
ALL = "_all"
CARD_SCHEMA = "item_id long, platform string, source string, category string, subcategories array<string>, rank_at timestamp"
PART_SCHEMA = "platform string, dimension string, value string, bucket int, total_count long, max_rank_at timestamp"
SCOPE_SCHEMA = "platform string, dimension string, value string, total_count long, max_rank_at timestamp"
KEY = ["platform", "dimension", "value"]


def in_scopes(cards: DataFrame) -> DataFrame:
    """One row for every scope that a card is in: its columns, and the scope's as scope.platform, scope.dimension, scope.value."""
    scope = lambda platform, dimension, value: F.struct(platform.alias("platform"), F.lit(dimension).alias("dimension"), value.alias("value"))
    everywhere, own = F.lit(ALL), F.col("platform")
    within = F.transform(F.array_distinct(F.coalesce("subcategories", F.array())), lambda s: scope(everywhere, "section_subcategory", F.concat(F.col("category"), F.lit(WITHIN), s)))
    fixed = F.array(
        scope(everywhere, "all", F.lit("")), scope(own, "all", F.lit("")), scope(own, "source", F.col("source")),
        scope(everywhere, "section_category", F.col("category")), scope(own, "category", F.col("category")))
    known = F.filter(F.concat(fixed, within), lambda s: s["platform"].isNotNull() & s["value"].isNotNull())
    return cards.withColumn("scope", F.explode(known))


def rolled_up(cards: DataFrame) -> DataFrame:
    """The whole roll-up from scratch: what the kept one must equal."""
    return in_scopes(cards).groupBy(*[F.col("scope")[c].alias(c) for c in KEY]).agg(F.count("*").alias("total_count"), F.max("rank_at").alias("max_rank_at"))


class ReadModel:
    def __init__(self, tables: VersionedTables) -> None:
        self.tables = tables

    def scopes(self, version: Version | None = None) -> DataFrame:
        return self.tables.read(version or self.tables.current(), "scopes", SCOPE_SCHEMA)

    def cards(self, version: Version | None = None) -> DataFrame:
        return self.tables.read(version or self.tables.current(), "cards", CARD_SCHEMA)

    def refresh(self, delta: DataFrame, facts: dict | None = None) -> Version:
        """Brings in changed items (the columns of CARD_SCHEMA, and deleted), one row an item; gives the version that has them."""
        before = self.tables.current()
        names = [c.split()[0] for c in CARD_SCHEMA.split(", ")]
        delta = keep(delta.select(*names, F.coalesce("deleted", F.lit(False)).alias("deleted"), bucket_of("item_id", buckets=ITEM_BUCKETS).alias("bucket")))
        touched = sorted(r.bucket for r in delta.select("bucket").distinct().collect())
        if not touched:
            discard(delta)
            return self.tables.commit(before, {}, facts or {}) if facts else before
        stored = self.tables.read(before, "cards", CARD_SCHEMA, touched)
        was, now = stored.join(delta.select("item_id"), "item_id", "left_semi"), delta.where("not deleted").select(names)
        cards = keep(stored.join(delta.select("item_id"), "item_id", "left_anti").select(names).unionByName(now).withColumn("bucket", bucket_of("item_id", buckets=ITEM_BUCKETS)))
        scope = [F.col("scope")[c].alias(c) for c in KEY]
        parts = in_scopes(cards).groupBy(*scope, "bucket").agg(F.count("*").alias("total_count"), F.max("rank_at").alias("max_rank_at"))
        affected = keep(in_scopes(was).select(*scope).unionByName(in_scopes(now).select(*scope)).distinct().withColumn("scope_bucket", bucket_of(*KEY, buckets=SCOPE_BUCKETS)))
        scope_buckets = sorted(r.scope_bucket for r in affected.select("scope_bucket").distinct().collect())
        changed = {"cards": (touched, self.tables.write(cards, "bucket", touched)), "parts": (touched, self.tables.write(parts.withColumn("at", F.col("bucket")), "at", touched))}
        # the parts as they will be: those just written and those of untouched buckets
        kept = {b: p for b, p in before.tables.get("parts", {}).items() if int(b) not in touched} | changed["parts"][1]
        every = self.tables.read(Version(0, {"parts": kept}), "parts", PART_SCHEMA)
        again = every.join(affected.select(KEY), KEY, "left_semi").groupBy(*KEY).agg(F.sum("total_count").alias("total_count"), F.max("max_rank_at").alias("max_rank_at"))
        same = self.tables.read(before, "scopes", SCOPE_SCHEMA, scope_buckets).join(affected.select(KEY), KEY, "left_anti")
        rows = same.unionByName(again).withColumn("scope_bucket", bucket_of(*KEY, buckets=SCOPE_BUCKETS))
        changed["scopes"] = (scope_buckets, self.tables.write(rows, "scope_bucket", scope_buckets))
        version = self.tables.commit(before, changed, facts or {})
        discard(delta, cards, affected)
        return version

    def catch_up(self, changes: DataFrame, start: datetime, now: datetime, window: timedelta) -> Iterator[tuple[Version, bool]]:
        """Works off changes (CARD_SCHEMA, deleted, changed_at) in shards from the watermark on, or from ``start`` where there is
        none; gives each version and whether it has reached ``now``."""
        dated = changes.where(F.col("item_id").isNotNull() & F.col("changed_at").isNotNull())
        while True:
            low = self.tables.current().facts.get("watermark")
            low = datetime.fromisoformat(low) if low else start
            high = shard_end(low, now, window)
            if high <= low:
                return
            shard = dated.where((F.col("changed_at") > F.lit(low)) & (F.col("changed_at") <= F.lit(high)))
            last = F.max_by(F.struct(*[c for c in changes.columns if c != "item_id"]), F.struct("changed_at", ~F.coalesce("deleted", F.lit(False)), "rank_at"))
            yield self.refresh(shard.groupBy("item_id").agg(last.alias("s")).select("item_id", "s.*"), {"watermark": high.isoformat()}), high == now


def shard_end(low: datetime, now: datetime, window: timedelta) -> datetime:
    return min(low + window, now)
