"""Filters, joins, windows and pages of content feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

#: Names that a category has had before. Fixed values.
ALIASES = {"ai_tools": "efficiency_tools", "tools": "efficiency_tools", "insights": "tech"}
UNCATEGORIZED = "__uncategorized__"


def canonical_category(c: Column) -> Column:
    """Lower-case category without its sub-level, under its present name."""
    first = F.lower(F.trim(F.substring_index(c, "/", 1)))
    out = F.when(first == "", None)
    for old, new in ALIASES.items():
        out = out.when(first == old, new)
    return out.otherwise(first)


def expand_category(name: str) -> list[str]:
    return [name, *sorted(old for old, new in ALIASES.items() if new == name)]


def visible_display(source: Column, platform: Column, stars: Column | None = None, least_stars: int = 50) -> Column:
    """Neither a search nor a bookmark list, nor a repository with few stars."""
    shown = ~F.coalesce(source, F.lit("")).startswith("search:") & ~((platform == "twitter") & (source == "bookmarks"))
    return shown if stars is None else shown & ((platform != "github") | (F.coalesce(stars, F.lit(0)) >= least_stars))


def visible_manual(platform: Column, owner: Column, user: str | None) -> Column:
    """Manual items are shown to their owner only."""
    return (platform != "manual") | (F.lit(False) if user is None else F.coalesce(owner == user, F.lit(False)))


def relevant(category: Column, categories: Column) -> Column:
    return (category.isNotNull() & (category != "other")) | (categories.isNotNull() & (F.size(categories) > 0))


def in_category(categories: Column, wanted: str) -> Column:
    """An array holds a category under any of its names; the sentinel asks for items without categories."""
    if wanted == UNCATEGORIZED:
        return categories.isNull()
    return F.arrays_overlap(categories, F.array(*[F.lit(n) for n in expand_category(wanted)]))


def searched(words: str, *columns: str) -> Column:
    """Any of the columns contains the words, whatever their case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).contains(words.lower()), F.lit(False))
    return out


def in_window(ts: Column, start: str, end: str) -> Column:
    """Half-open."""
    return (ts >= F.to_timestamp_ntz(F.lit(start))) & (ts < F.to_timestamp_ntz(F.lit(end)))


def with_status(items: DataFrame, status: DataFrame, user: int | None, key: str = "item_id", user_column: str = "user_id") -> DataFrame:
    """Items with one user's state; without a user nothing joins, so no other's state shows."""
    own = status.where(F.lit(False) if user is None else F.col(user_column) == user).drop(user_column)
    return items.join(own, key, "left")


def in_state(unread: bool = False, starred: bool = False, clicked: bool = False) -> Column:
    """Rows of with_status() in all of the asked states. An item is unread if it was neither clicked nor hidden, or has no
    status at all."""
    out = F.lit(True)
    if unread:
        out = out & F.col("clicked_at").isNull() & F.col("hidden_at").isNull()
    if starred:
        out = out & F.col("starred_at").isNotNull()
    return out & F.col("clicked_at").isNotNull() if clicked else out


def holds_any(keyword: str | None, *columns: str) -> Column:
    """A keyword stands in any of the columns, strings or arrays of strings, whatever its case; no keyword, no filter."""
    if not keyword:
        return F.lit(True)
    low = F.lit(keyword.lower())
    texts = [F.coalesce(F.concat_ws("\n", c), F.lit("")) for c in columns]  # null arrays and elements are nothing
    out = F.lit(False)
    for t in texts:
        out = out | F.contains(F.lower(t), low)
    return out


def page_of(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with what a reader needs to go on: total, has_more and next_offset (null on the last page). A page behind the
    end has no rows; limit 0 means all."""
    total = df.agg(F.count("*").alias("total"))
    more = F.lit(False) if not limit else F.col("total") > offset + limit
    rows = page(df, order, limit, offset).join(F.broadcast(total), how="cross")
    return rows.withColumn("has_more", more).withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit).cast("long")))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page; limit 0 means all."""
    out = df.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def keyset_page(df: DataFrame, rank: str, after: int, limit: int, exclude: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """The rows behind a cursor, without those already shown, and one more that tells whether there is a next page."""
    left = df.where(F.col(rank) > after)
    if exclude is not None:
        left = left.join(exclude.select(key).distinct(), key, "left_anti")
    return left.orderBy(rank).limit(limit + 1)


def in_order(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows asked for, with their place; ``wanted`` has columns place and the key."""
    return wanted.groupBy(key).agg(F.min("place").alias("place")).join(df, key)


def numbered(df: DataFrame, value: str, key: str, name: str, group: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds the row's number, from 1, in order of value and key, and ``<name>_of``, the number of rows of its group. Rows are
    numbered by ranges of values, so neither a large group nor a table without groups meets in one task."""
    order = F.desc_nulls_last(value) if descending else F.asc(value)
    placed = ranks.numbered(df, [order, F.asc(key)], group, name)
    if not group:
        return placed.join(F.broadcast(df.agg(F.count("*").alias(f"{name}_of"))), how="cross")
    sizes = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in group]).agg(F.count("*").alias(f"{name}_of"))
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return placed.join(sizes, same).drop(*[f"_of_{c}" for c in group])


def with_percentile(df: DataFrame, group: str, value: str, key: str, name: str) -> DataFrame:
    """Adds the share of the group with smaller values, ties in order of key; 0 for a group of one."""
    out = numbered(df, value, key, "_place", [group])
    return out.withColumn(name, (F.col("_place") - 1) / F.greatest(F.col("_place_of") - 1, F.lit(1))).drop("_place", "_place_of")


def not_in(df: DataFrame, key: str, listed: DataFrame, column: str) -> DataFrame:
    """Rows whose key is not listed, as NOT IN has it: a null in the list leaves no row, a null key none but beside an
    empty list."""
    some, null = listed.select(column).limit(1), listed.where(F.col(column).isNull()).select(column).limit(1)
    left = df.join(listed.select(F.col(column).alias(key)), key, "left_anti").join(null, F.lit(True), "left_anti")
    return left.where(F.col(key).isNotNull()).unionByName(df.where(F.col(key).isNull()).join(some, F.lit(True), "left_anti"))


def runs(df: DataFrame, group: str, order: Sequence[str], flag: Column) -> DataFrame:
    """Runs of rows in a row for which the flag holds: group, length, first and last of the first order column."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = df.withColumn("_flag", flag).withColumn("_place", F.row_number().over(w))
    hits = marked.where("_flag").withColumn("_island", F.col("_place") - F.row_number().over(w))
    return hits.groupBy(group, "_island").agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")).drop("_island")


def round_robin(df: DataFrame, bucket: str, order: Sequence[Column], n: int) -> DataFrame:
    """n rows taken in turn from each bucket, buckets in order of name."""
    w = Window.partitionBy(bucket).orderBy(*order)
    # a bucket gives at most n rows, so the sort over all buckets stays small
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", bucket).limit(n)


def dominant(df: DataFrame, group: str, value: str, priority: Sequence[str]) -> DataFrame:
    """The commonest value of each group; ties by priority, then by name."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(value)), F.lit(0))
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("n"), F.when(place == 0, len(priority) + 1).otherwise(place).alias("p"), F.col(value).alias("v"))
    return counted.groupBy(group).agg(F.min(order).alias("o")).select(group, F.col("o.v").alias(value), (-F.col("o.n")).alias("n"))
