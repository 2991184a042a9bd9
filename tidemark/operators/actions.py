"""Action boards: filters, counts, merges and edits of the things that readers decide to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import discard, keep

#: Statuses that a board shows as one lane. Fixed values.
IN_PROGRESS = ("confirmed", "executing", "needs_verification")


def has_status(status: Column, wanted: str) -> Column:
    return status.isin(*IN_PROGRESS) if wanted == "in_progress" else status == wanted


def in_last_days(ts: Column, today: Column, days: int) -> Column:
    """Within the last calendar days, today included; rows without a time pass."""
    day = F.to_date(ts)
    return ts.isNull() | ((day > F.date_sub(today, days)) & (day <= today))


def clamped(limit: int, most: int = 100) -> int:
    return max(1, min(limit, most))


def status_counts(actions: DataFrame, status: str, order: Sequence[str]) -> DataFrame:
    """One row per status in a board's own order, then the derived lanes ``in_progress`` and ``total``."""
    counts = actions.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    lanes = counts.select(
        F.explode(F.array(F.col("status"), F.when(F.col("status").isin(*IN_PROGRESS), F.lit("in_progress")), F.lit("total"))).alias("status"), "n"
    ).where("status is not null")
    place = F.array_position(F.array(*[F.lit(s) for s in (*order, "in_progress", "total")]), F.col("status")).cast("int")
    return lanes.groupBy("status").agg(F.sum("n").alias("n")).withColumn("place", place)


def ids_of(text: Column) -> Column:
    """The ids of a JSON array, null where the text is none."""
    return F.from_json(text, "array<string>")


def holds_id(text: Column, wanted: str) -> Column:
    """A JSON array holds an id: the cheap text search first, then the exact one."""
    return text.contains(wanted) & F.coalesce(F.array_contains(ids_of(text), wanted), F.lit(False))


def edited(pairs: Sequence[tuple[str, str]]) -> Column:
    """Any of the columns differs from its original; an original that is null was never edited."""
    out = F.lit(False)
    for original, now in pairs:
        out = out | F.coalesce(F.col(original) != F.col(now), F.lit(False))
    return out


def ordered_union(*arrays: Column) -> Column:
    """All arrays' elements, each where it stands first."""
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))


def appended(old: Column, new: Column) -> Column:
    """``new`` behind ``old`` unless it is part of it."""
    return F.when((F.coalesce(new, F.lit("")) == "") | old.contains(new), old).when(F.coalesce(old, F.lit("")) == "", new).otherwise(F.concat(old, F.lit("\n"), new))


def keep_first_of_case(df: DataFrame, name: str, order: str) -> DataFrame:
    """Of rows whose trimmed names differ in case only, the first; blank names go."""
    folded = F.lower(F.trim(F.col(name)))
    first = F.row_number().over(Window.partitionBy(folded).orderBy(order))
    return df.where(folded != "").withColumn("_first", first).where("_first = 1").drop("_first")


def new_titles(new: DataFrame, known: DataFrame, least: int = 10) -> DataFrame:
    """Rows of ``new`` (id, title) whose title neither equals a known one nor, being longer than ``least``, holds or is
    held by one. What is held begins with letters that stand somewhere in what holds it, so titles meet by these."""
    a = new.select("id", F.lower(F.trim("title")).alias("a"))
    b = known.select(F.lower(F.trim("title")).alias("b")).where("b <> ''").distinct()
    n = least + 1

    def within(held: DataFrame, h: str, holding: DataFrame, w: str) -> DataFrame:
        heads = held.where(F.length(h) >= n).withColumn("key", F.substring(h, 1, n))
        places = F.transform(F.sequence(F.lit(1), F.length(w) - least), lambda i: F.substr(F.col(w), i, F.lit(n)))
        grams = holding.where(F.length(w) >= n).withColumn("key", F.explode(F.array_distinct(places)))
        return heads.join(grams, "key").where(F.col(w).contains(F.col(h))).select("id")

    hit = a.join(b, F.col("a") == F.col("b")).select("id").union(within(a, "a", b, "b")).union(within(b, "b", a, "a")).distinct()
    return new.join(hit, "id", "left_anti")


def like_titles(titles: DataFrame, least: int = 10) -> DataFrame:
    """a, b: pairs of distinct titles (column ``title``) of which one, longer than ``least``, stands within the other; both ways
    round. The one that is held meets the other by its rarest gram of ``least + 1`` letters, so common beginnings do not
    bring all titles together."""
    n = least + 1
    long = titles.where(F.char_length("title") >= n).select("title")
    signs = F.transform(F.sequence(F.lit(1), F.char_length("title") - least), lambda i: F.substr(F.col("title"), i, F.lit(n)))
    grams = keep(long.select("title", F.explode(F.array_distinct(signs)).alias("gram")))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(counts, "gram").groupBy("title").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    met = rarest.withColumnRenamed("title", "a").join(grams.withColumnRenamed("title", "b"), "gram")
    held = keep(met.where("a <> b AND contains(b, a)").select("a", "b"))
    discard(grams)
    out = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    out.kept_at = held.kept_at
    return out


def kept_in_order(new: DataFrame, known: DataFrame, least: int = 10) -> DataFrame:
    """Rows of ``new`` (id, title) that a pass in order of id keeps: a title goes if it equals a known one or one kept before, or
    if, of the two, one longer than ``least`` holds the other. Case and blanks around do not count.

    Whether a row stays depends on those before it, so it is settled by rounds over the pairs of like titles: rows without
    an undecided like one before them stay, and what is like them goes; the rest is the next round. Rounds are as many as
    the longest chain of titles of which each waits for the one before.

    Null titles are empty ones, of which the first stays. Null ids are left out; ids must differ.
    """
    folded = lambda df: df.select("*", F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("_t"))
    rows = folded(new.where(F.col("id").isNotNull()))
    # of equal titles only the first can stay
    first = keep(rows.groupBy("_t").agg(F.min("id").alias("id")).select("id", F.col("_t").alias("title")))
    old = folded(known).where("_t <> ''").select(F.col("_t").alias("title")).distinct()
    like = like_titles(first.select("title").union(old).distinct(), least)
    pairs = keep(like.join(first.select(F.col("title").alias("b"), F.col("id").alias("y")), "b").select("a", "y"))
    gone = first.join(old, "title", "left_semi").select("id").union(pairs.join(old.withColumnRenamed("title", "a"), "a", "left_semi").select(F.col("y").alias("id")))
    open_ = keep(first.join(gone, "id", "left_anti").select("id"))
    edges = keep(pairs.join(first.select(F.col("title").alias("a"), F.col("id").alias("x")), "a").select("x", "y").where("x < y"))
    stay = []
    while True:
        live = edges.join(open_.toDF("x"), "x", "left_semi").join(open_.toDF("y"), "y", "left_semi")
        waiting = live.select(F.col("y").alias("id")).distinct()
        now = keep(open_.join(waiting, "id", "left_anti"))
        stay.append(now)
        dropped = live.join(now.toDF("x"), "x", "left_semi").select(F.col("y").alias("id")).distinct()
        before, open_ = open_, keep(open_.join(now, "id", "left_anti").join(dropped, "id", "left_anti"))
        discard(before)
        if open_.isEmpty():
            break
    kept = stay[0]
    for more in stay[1:]:
        kept = kept.union(more)
    kept = keep(kept)
    discard(first, like, pairs, edges, open_, *stay)
    return new.join(kept, "id", "left_semi")
