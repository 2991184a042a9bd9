"""Metrics of clusterings, thresholds and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def pair_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Pairwise precision, recall and F1 and purity, from the contingency table: no pair is formed."""
    pairs = lambda n: n * (n - 1) / 2
    cells = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("tp"), F.sum("n").alias("items"))
    t = cells.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("same_truth"))
    p = cells.groupBy(predicted).agg(F.sum("n").alias("n"), F.max("n").alias("top")).agg(F.sum(pairs(F.col("n"))).alias("same_predicted"), F.sum("top").alias("top"))
    one = both.join(t).join(p)
    precision, recall = F.try_divide("tp", "same_predicted"), F.try_divide("tp", "same_truth")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return one.select(
        F.col("tp").cast("long").alias("tp"), (F.col("same_predicted") - F.col("tp")).cast("long").alias("fp"), (F.col("same_truth") - F.col("tp")).cast("long").alias("fn"),
        zero(precision).alias("precision"), zero(recall).alias("recall"),
        zero(F.try_divide(2 * F.col("tp"), F.col("same_predicted") + F.col("same_truth"))).alias("f1"), zero(F.col("top") / F.col("items")).alias("purity"),
    )


def cluster_faults(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: pairs rightly kept apart (tn), predicted clusters that hold several true ones (over_merged) and how many items they
    hold, true clusters that are spread over several predicted ones (split), and items. From the contingency table: no pair
    is formed. Null labels are clusters of their own."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    by = lambda name: cells.groupBy(name).agg(F.sum("n").alias("n"), F.count("*").alias("others"))
    tp = cells.agg(F.sum(pairs(F.col("n"))).alias("tp"), F.sum("n").alias("items"))
    truths = by("t").agg(F.sum(pairs(F.col("n"))).alias("same_truth"), F.count_if(F.col("others") > 1).alias("split"))
    several = F.col("others") > 1
    found = by("p").agg(F.sum(pairs(F.col("n"))).alias("same_predicted"), F.count_if(several).alias("over_merged"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("in_over_merged"))
    tn = pairs(F.col("items")) - F.col("same_truth") - F.col("same_predicted") + F.col("tp")
    return tp.join(truths, how="cross").join(found, how="cross").select(tn.cast("long").alias("tn"), "over_merged", "in_over_merged", "split", "items")


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str, label: Column) -> DataFrame:
    """Counts, precision, recall and F1 for every threshold, in one pass."""
    rows = df.select(F.col(score).alias("s"), label.alias("y"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    hit, y = F.col("s") >= F.col("threshold"), F.col("y")
    sums = rows.groupBy("threshold").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "threshold", "tp", "fp", "fn", zero(F.try_divide(tp, tp + fp)).alias("precision"), zero(F.try_divide(tp, tp + fn)).alias("recall"),
        zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Fewest errors, then best F1, precision, recall, then the lowest threshold."""
    return sweep.orderBy(F.col("fp") + F.col("fn"), F.desc("f1"), F.desc("precision"), F.desc("recall"), "threshold").limit(1)


def nearest_rank(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """Percentiles that are values of the group: the ceil(p n)-th smallest. Values are counted, and their running counts come
    from ranges of values, so a group of any size is spread over tasks. Null values are the smallest."""
    counts = df.groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = ranks.running(counts, [F.asc("v")], [group], F.col("c"), "before")
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"))
    ranked = placed.join(sizes, F.col(group).eqNullSafe(F.col("_g")))
    wanted = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1))
    at = lambda p: F.max(F.when((F.col("before") + F.col("c") >= wanted(p)) & (F.col("before") < wanted(p)), F.col("v")))
    return ranked.groupBy(group).agg(*[at(p).alias(f"p{round(p * 100)}") for p in shares])


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """value and ``name``: the rank from 1 of each value, in which ties share their mean. One row per value."""
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    placed = ranks.running(counts, [F.asc(value)], (), F.col("_c"), "_before")
    return placed.select(value, (F.col("_before") + 1 + (F.col("_c") - 1) / 2.0).alias(name))
