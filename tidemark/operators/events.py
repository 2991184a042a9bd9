"""Grouping items into events: recall, bands, components and centroids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, norm
from ..sources.kept import discard, keep
from . import tiles

STRONG, GRAY, SHADOW = 0.75, 0.70, 0.65
CANDIDATE, DIAMETER, MOST_MEMBERS = 0.60, 0.55, 50
TAU_HOURS = 24.0


def band(cosine: Column, shares_entity: Column | None = None) -> Column:
    """strong, gray (only where an entity is shared, if that is known), shadow, or null."""
    gray = cosine >= GRAY if shares_entity is None else (cosine >= GRAY) & shares_entity
    return F.when(cosine >= STRONG, "strong").when(gray, "gray").when(cosine >= SHADOW, "shadow")


def cosine_pairs(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """All pairs (a < b) of vectors with a cosine of at least ``least``, tile against tile."""
    return tiles.pairs(vectors, least, key, vector)


def top_k(queries: DataFrame, stored: DataFrame, k: int, least: float) -> DataFrame:
    """For each query (q, qv) the k stored vectors (s, sv) with the largest cosine, ties by s: every query meets every stored
    vector. ``cells.top_k`` gives the same rows from an index."""
    # lengths are taken once per vector, before the join
    queries, stored = queries.withColumn("qn", norm(F.col("qv"))), stored.withColumn("sn", norm(F.col("sv")))
    scored = queries.join(stored).select("q", "s", F.try_divide(dot(F.col("qv"), F.col("sv")), F.col("qn") * F.col("sn")).alias("cosine")).where(F.col("cosine") >= least)
    order = Window.partitionBy("q").orderBy(F.desc(F.round("cosine", 9)), "s")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def connected(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Every node with the smallest node it is connected with: minimum labels spread and jump until nothing changes. Each
    round is a table in the shared folder, so lineage does not double and lost executors lose nothing."""
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = kept = keep(nodes.select(F.col(node).alias("id"), F.col(node).alias("label")))
    while True:
        near = both.join(labels, both.a == labels.id).groupBy("b").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.id == near.b, "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        out = keep(step.join(jump, "new").select("id", F.col("label").alias("old"), F.least("new", "far").alias("label")))
        changed = not out.where("old <> label").isEmpty()
        discard(kept)
        labels, kept = out.select("id", "label"), out
        if not changed:
            discard(both)
            return labels


def centroids(df: DataFrame, group: str, vector: str, weight: Column | None = None, digits: int | None = None) -> DataFrame:
    """Weighted mean vector of each group; plain mean where all weights are 0."""
    w = F.lit(1.0) if weight is None else weight
    flat = df.select(group, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = flat.groupBy(group, "i").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("s"), F.sum("w").alias("t"), F.avg(F.col("x").cast("double")).alias("m"))
    value = F.when(F.col("t") == 0, F.col("m")).otherwise(F.col("s") / F.col("t"))
    value = value if digits is None else F.round(value, digits)
    listed = sums.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", value.alias("x")))).alias("p"))
    return listed.select(group, F.transform("p", lambda p: p["x"]).alias("centroid"))


def agglomerate(df: DataFrame, group: str, key: str, order: list[str], vector: str) -> DataFrame:
    """Single pass over each group in order: an item joins the nearest centroid that allows it, or founds a cluster.

    The pass depends on order by definition, so a group (a window of days) is worked through in one task.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        vectors = np.array(rows["_v"].tolist(), dtype=np.float64)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        members: list[list[int]] = []
        middles = np.zeros((0, vectors.shape[1]))
        label = np.zeros(len(rows), dtype=np.int64)
        for i, v in enumerate(vectors):
            near = middles @ v
            for c in np.argsort(-near, kind="stable"):
                if near[c] < CANDIDATE:
                    c = None
                    break
                if len(members[c]) < MOST_MEMBERS and (vectors[members[c]] @ v).min() >= DIAMETER:
                    break
            else:
                c = None
            if c is None:
                members.append([i])
                middles = np.vstack([middles, v])
                label[i] = len(members) - 1
            else:
                members[c].append(i)
                mean = vectors[members[c]].mean(axis=0)
                middles[c] = mean / (np.linalg.norm(mean) or 1)
                label[i] = c
        return pd.DataFrame({group: rows[group], key: rows[key], "cluster": label})

    slim = df.select(group, key, *[c for c in order if c not in (group, key)], F.col(vector).alias("_v"))
    return slim.groupBy(group).applyInPandas(run, f"{group} long, {key} long, cluster long")
