"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. Each source has a target number of words; the documents' rates are the
ones nearest to 1 (in relative entropy, none above ``CAP``) whose words add up to the target. They have the form
``min(CAP, exp(multiplier * size / mean size))``, one multiplier per source, which solves a convex dual. Newton's
method finds all multipliers at once: sums over the counts of (source, size) are taken by Spark in every step, and
bisection steps in where Newton's would leave the bracket. Rates become whole copies by error diffusion from large
to small documents within buckets of a source, so that what is left over is about a small document per bucket.

Null texts have size 0 and are taken 0 times over. A null source is a source of its own and sorts last. Repeated
rows count as documents of their own; they are rounded together as one row with a count, however many they are. An empty table gives an empty result. A source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table, word_array

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: Mean number of documents that are rounded together.
BUCKET_DOCS = 512
#: Newton steps end when each source's words are this near to its target, or after MOST_STEPS; further off than LEAST_NEAR
#: they have failed.
TOLERANCE = 1e-6
LEAST_NEAR = 1e-3
MOST_STEPS = 60
#: Newton steps between two tables written.
STEPS_A_JOB = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: source, docs, source_size, target.

    Sources in code point order, null last, get the weights in turn. They share all words by weight, but none gets
    more than ``cap`` times its size; what is cut off is shared by the others. Sorted by capacity for its weight,
    the sources that are cut off come first, so the common level of the others follows from running sums.
    """
    sources = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    # windows over all sources: one row per source, no documents
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ).withColumn("capacity", cap * F.col("source_size"))
    order = Window.orderBy(F.col("capacity") / F.col("weight"), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighted.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("level") <= F.col("capacity") / F.col("weight"), F.struct(F.col("capacity") / F.col("weight"), "level"))).over(everywhere)["level"]
    )
    return leveled.select(
        "source", "docs", "source_size", F.least("capacity", F.coalesce(F.col("weight") * F.col("level"), "capacity")).alias("target")
    )


def _newton_step(state: DataFrame, counts: DataFrame, cap: float) -> DataFrame:
    """One step for all sources: the words that the present multipliers take, their slope, and the next multipliers."""
    x = F.col("size") / F.col("mean")
    raw = F.exp(F.least(F.col("multiplier") * x, F.lit(50.0)))
    words = F.col("n") * F.col("size")
    sums = (
        counts.join(state.select(F.col("source").alias("_s"), "mean", "multiplier"), F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("source")
        .agg(F.sum(words * F.least(raw, F.lit(cap))).alias("got"), F.sum(F.when(raw < cap, words * x * raw).otherwise(0.0)).alias("slope"))
        .select(F.col("source").alias("_s"), "got", "slope")
    )
    m, lo, hi = F.col("multiplier"), F.col("lo"), F.col("hi")
    joined = state.drop("got").join(sums, F.col("source").eqNullSafe(F.col("_s")))
    short = F.col("got") < F.col("target")
    bracketed = joined.withColumn("lo", F.when(short, m).otherwise(lo)).withColumn("hi", F.when(short, hi).otherwise(m))
    # on the logarithm of the words the dual is nearly straight
    newton = m + F.when(F.col("slope") > 0, (F.log("target") - F.log("got")) * F.col("got") / F.col("slope"))
    inside = newton.isNotNull() & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
    other = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).when(hi.isNull(), lo + F.abs(lo) + 1).otherwise(hi - F.abs(hi) - 1)
    done = F.abs(F.col("got") - F.col("target")) <= TOLERANCE * F.col("target")
    return bracketed.withColumn("done", done).withColumn("multiplier", F.when(done, m).when(inside, newton).otherwise(other)).drop("slope", "_s")


def solve_multipliers(sizes: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds multiplier to ``targets``: null where a source is taken whole, ``cap`` times over, or has no words."""
    counts = keep(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = keep(targets)
    # a target at its cap has its multiplier at infinity
    open_ = targets.where((F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-9)))
    mean = F.col("source_size") / F.col("docs")
    state = open_.select(
        "source", "target", mean.alias("mean"), F.log(F.col("target") / F.col("source_size")).alias("multiplier"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("double").alias("got"),
        F.lit(False).alias("done"),
    )
    for _ in range(0, MOST_STEPS, STEPS_A_JOB):
        for _ in range(STEPS_A_JOB):
            state = _newton_step(state, counts, cap)
        state = keep(state)
        if state.where("not done").isEmpty():
            break
    else:
        off = state.where(F.abs(F.col("got") - F.col("target")) > LEAST_NEAR * F.col("target")).count()
        if off:
            raise RuntimeError(f"{off} sources are off their targets after {MOST_STEPS} steps")
    found = state.select(F.col("source").alias("_s"), "multiplier")
    return targets.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _diffuse(cap: float):
    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        rates, sizes, times = (group[c].to_numpy() for c in ("rate", "size", "times"))
        low = np.floor(rates + 1e-9)
        high = np.minimum(low + 1, cap)
        copies, left = np.zeros(len(group), dtype=np.int64), 0.0
        for i, (size, n) in enumerate(zip(sizes, times)):
            if size:
                left += rates[i] * size * n
                copies[i] = min(max(round(left / size), low[i] * n), high[i] * n)
                left -= copies[i] * size
        return group[["doc_id", "source", "size", "source_size", "target", "rate", "times"]].assign(copies=copies)

    return rounded


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Returns doc_id, source, size, source_size, target, rate, copies, taken: one row per row of ``docs``."""
    sizes = keep(docs.select(
        "doc_id", "source", F.size(word_array("text")).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("part")
    ))
    solved = solve_multipliers(sizes, source_targets(sizes, weights, cap), cap)
    mean = F.col("source_size") / F.col("docs")
    rate = F.when(F.col("source_size") == 0, 1.0).when(F.col("multiplier").isNull(), cap).otherwise(
        F.least(F.lit(cap), F.exp(F.least(F.col("multiplier") * F.col("size") / mean, F.lit(50.0))))
    )
    once = sizes.groupBy("doc_id", "source", "size", "part").agg(F.count("*").alias("times"))
    rated = once.join(solved.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", rate.alias("rate"), "part",
        F.pmod(F.col("part"), F.ceil(F.col("docs") / BUCKET_DOCS)).alias("bucket"), "times",
    )
    whole = rated.groupBy("source", "bucket").applyInPandas(
        _diffuse(cap), "doc_id long, source string, size long, source_size long, target double, rate double, times long, copies long"
    )
    # of a row's repeats the first take one copy more, if copies are left over
    each = whole.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    own = (F.floor(F.col("copies") / F.col("times")) + (F.col("_i") <= F.col("copies") % F.col("times")).cast("long")).alias("copies")
    return each.select("doc_id", "source", "size", "source_size", "target", "rate", own).withColumn("taken", F.col("copies") * F.col("size"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
