"""Clustering item by item, batch by batch: each item joins the best cluster that recall, band and time allow, or founds one.

The outcome depends on the order of items (time, null last, then id), and is defined by one pass over all of them. A batch
need not be one pass, though. Centroids are sums of unit vectors, and a member joins only at a cosine of ``gray`` or more, so
each member makes the sum longer by ``gray`` at least. Hence an item can join a cluster only if its cosine to the stored
centroid, or to a member that came in the same batch, is ``gray ** 2`` or more, and only if they lie within the largest
span of time. Items and clusters that no such link connects can't affect each other: components of these links are worked
through apart from each other, each in order, and together they give what one pass gives. Links are found tile against tile;
a tile gives no more of them than connect what it holds, as most pairs may be links where vectors don't lie in clusters. A
component is at most the batch and the clusters it can reach, and one task; the caller bounds batches. The task compares
some items at once with the clusters that were there before them, in single precision; only what may be near enough, and
what the items just before have changed, is worked out in double precision in order.

State is a folder: ``clusters/batch=n`` holds the clusters that batch n founded or changed, ``assigned/batch=n`` its items;
``assigned`` is written last, so a batch without its mark was not finished and is run again from the state before it. Items
that an earlier batch has assigned are left out. A cluster is named by the item that founded it.

Items without a vector are left out. Items without time pass every time gate and leave their cluster's times alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kept import discard, exists, keep
from . import cells, events, tiles

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Items that are compared at once with the clusters before them, and clusters that they are multiplied with at once.
TOGETHER, COLUMNS = 256, 16_384
ASSIGNED_SCHEMA = "id long, cluster long, founded boolean, band string, cosine double"
CLUSTER_SCHEMA = "cluster long, total array<double>, n long, first long, last long, author string, category string, entities array<string>"
_STEP_SCHEMA = (
    "kind string, id long, cluster long, founded boolean, band string, cosine double, total array<double>, n long, first long, last long, "
    "author string, category string, entities array<string>"
)


@dataclass(frozen=True)
class Policy:
    """strong: joins at once; gray: joins only with the anchors of gray_allowed(). The k nearest clusters are looked at."""

    strong: float = 0.75
    gray: float = 0.70
    k: int = 10
    gray_hours: float = 2.0
    adjacent_days: float = 3.0
    span_days: float = 7.0


def adjacent(t: int | None, first: int | None, last: int | None, policy: Policy) -> bool:
    """Whether an item's time lies near a cluster's times, and both together within the largest span."""
    if t is None or first is None or last is None:
        return True
    near = first <= t + policy.adjacent_days * DAY and last >= t - policy.adjacent_days * DAY
    return near and max(last, t) - min(first, t) <= policy.span_days * DAY


def gray_allowed(item: dict, cluster: dict, policy: Policy) -> bool:
    """Close in time, and of one author and category with an entity in common, one author with two, or one category with three."""
    t, first, last = item["t"], cluster["first"], cluster["last"]
    if t is None or first is None or last is None or max(first - t, t - last, 0) > policy.gray_hours * HOUR:
        return False
    author = item["author"] is not None and item["author"] == cluster["author"]
    category = item["category"] is not None and item["category"] == cluster["category"]
    shared = len(set(item["entities"]) & cluster["entities"])
    return (author and category and shared >= 1) or (author and shared >= 2) or (category and shared >= 3)


class Pass:
    """One pass in order over items, with the clusters that were there before, item by item: what _sequential() must give."""

    def __init__(self, policy: Policy, width: int) -> None:
        self.policy, self.clusters, self.totals = policy, [], np.zeros((0, width))
        self.sizes = np.zeros(0)

    def add_cluster(self, cluster: dict, total: np.ndarray) -> None:
        at = len(self.clusters)
        if at == len(self.totals):
            self.totals = np.vstack([self.totals, np.zeros((max(64, at), self.totals.shape[1]))])
            self.sizes = np.append(self.sizes, np.zeros(len(self.totals) - len(self.sizes)))
        self.clusters.append(cluster)
        self.totals[at], self.sizes[at] = total, np.linalg.norm(total)

    def place(self, item: dict, v: np.ndarray) -> tuple[int, bool, str | None, float | None]:
        """(cluster's place, founded, band, cosine) of an item that is placed now; ``v`` is its unit vector."""
        n = len(self.clusters)
        cos = np.round(self.totals[:n] @ v / np.maximum(self.sizes[:n], 1e-300), 9)
        near = [i for i in np.flatnonzero(cos >= self.policy.gray) if adjacent(item["t"], self.clusters[i]["first"], self.clusters[i]["last"], self.policy)]
        near.sort(key=lambda i: (-cos[i], self.clusters[i]["cluster"]))
        for i in near[: self.policy.k]:
            c = self.clusters[i]
            if cos[i] >= self.policy.strong or gray_allowed(item, c, self.policy):
                self.totals[i] += v
                self.sizes[i] = np.linalg.norm(self.totals[i])
                c["n"] += 1
                c["entities"] |= set(item["entities"])
                if item["t"] is not None:
                    c["first"], c["last"] = (item["t"], item["t"]) if c["first"] is None else (min(c["first"], item["t"]), max(c["last"], item["t"]))
                c["changed"] = True
                return i, False, "strong" if cos[i] >= self.policy.strong else "gray", float(cos[i])
        self.add_cluster({"cluster": item["id"], "n": 1, "first": item["t"], "last": item["t"], "author": item["author"], "category": item["category"], "entities": set(item["entities"]), "changed": True}, v)
        return n, True, None, None


def _sequential(policy: Policy):
    """One component, worked through in order; gives rows of _STEP_SCHEMA.

    A cluster has the number of the row that it comes from: the stored one, or the item that founded it.
    """
    schema = pa.schema([
        ("kind", pa.string()), ("id", pa.int64()), ("cluster", pa.int64()), ("founded", pa.bool_()), ("band", pa.string()), ("cosine", pa.float64()), ("total", pa.list_(pa.float64())),
        ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("author", pa.string()), ("category", pa.string()), ("entities", pa.list_(pa.string()))])

    def run(rows: pa.Table) -> pa.Table:
        column = lambda name: rows.column(name).combine_chunks()
        ids, t, n, first, last = (column(c).fill_null(0).to_numpy(zero_copy_only=False).copy() for c in ("id", "t", "n", "first", "last"))
        stored = column("stored").to_numpy(zero_copy_only=False)
        dated, open_ = column("t").is_valid().to_numpy(zero_copy_only=False), column("first").is_null().to_numpy(zero_copy_only=False).copy()
        authors, categories, listed = column("author"), column("category"), column("entities")
        totals = cells.stacked(column("v"))
        totals[~stored] = cells.unit(totals[~stored])
        sizes = np.linalg.norm(totals, axis=1)
        single = (totals / np.maximum(sizes, 1e-300)[:, None]).astype(np.float32)
        live, changed, touched = stored.copy(), np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        held: dict[int, set] = {}
        least = np.float32(policy.gray - tiles.rounding(totals.shape[1]) - 1e-9)

        def entities(i: int) -> set:
            return held[i] if i in held else set(listed[i].as_py())

        def bounds(c: int) -> tuple[int | None, int | None]:
            return (None, None) if open_[c] else (int(first[c]), int(last[c]))

        def allowed(i: int, c: int) -> bool:
            facts = lambda r: {"author": authors[r].as_py(), "category": categories[r].as_py(), "entities": entities(r)}
            begin, end = bounds(c)
            return gray_allowed(facts(i) | {"t": int(t[i]) if dated[i] else None}, facts(c) | {"first": begin, "last": end}, policy)

        def choose(i: int, near: np.ndarray) -> tuple[int, float] | None:
            cos = np.round(totals[near] @ totals[i] / np.maximum(sizes[near], 1e-300), 9)
            good = np.flatnonzero(cos >= policy.gray)
            looked, at = 0, int(t[i]) if dated[i] else None
            for g in good[np.lexsort((ids[near[good]], -cos[good]))].tolist():
                c = int(near[g])
                if not adjacent(at, *bounds(c), policy):
                    continue
                looked += 1
                if looked > policy.k:
                    return None
                if cos[g] >= policy.strong or allowed(i, c):
                    return c, float(cos[g])
            return None

        order = np.flatnonzero(~stored)
        order = order[np.lexsort((ids[order], t[order], ~dated[order]))]
        into, cosine = np.empty(len(order), np.int64), np.full(len(order), np.nan)
        for b in range(0, len(order), TOGETHER):
            some = order[b : b + TOGETHER]
            # a cluster that ended too long before an item can be joined by no later one either
            reach = live & (open_ | (last >= t[some[0]] - int(policy.adjacent_days * DAY) - 1)) if dated[some].all() else live
            known = np.flatnonzero(reach)
            hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for c in range(0, len(known), COLUMNS):
                x, y = np.divmod(np.flatnonzero(single[some] @ single[known[c : c + COLUMNS]].T >= least), len(known[c : c + COLUMNS]))
                hits.append((x, known[c + y]))
            who, near = map(np.concatenate, zip(*hits))
            near = near[np.argsort(who, kind="stable")]
            cuts = np.append(0, np.cumsum(np.bincount(who, minlength=len(some)))).tolist()
            fresh, many = np.empty(len(some), np.int64), 0
            for j, i in enumerate(some.tolist()):
                mine = near[cuts[j] : cuts[j + 1]]
                if many:
                    mine = np.concatenate([mine[~touched[mine]], fresh[:many]])
                found = choose(i, mine) if len(mine) else None
                if found is None:
                    c, live[i], n[i] = i, True, 1
                else:
                    c, cosine[b + j] = found
                    totals[c] += totals[i]
                    sizes[c] = np.linalg.norm(totals[c])
                    single[c] = totals[c] / max(sizes[c], 1e-300)
                    n[c] += 1
                    held[c] = entities(c) | entities(i)
                    if dated[i]:
                        first[c], last[c] = (t[i], t[i]) if open_[c] else (min(first[c], t[i]), max(last[c], t[i]))
                        open_[c] = False
                into[b + j], changed[c] = c, True
                if not touched[c]:
                    touched[c], fresh[many], many = True, c, many + 1
            touched[fresh[:many]] = False
        founded = into == order
        bands = np.where(founded, None, np.where(cosine >= policy.strong, "strong", "gray"))
        nothing = lambda names, size: {c: pa.nulls(size, schema.field(c).type) for c in names}
        placed = {
            "kind": pa.array(["item"] * len(order), pa.string()), "id": pa.array(ids[order]), "cluster": pa.array(ids[into]), "founded": pa.array(founded), "band": pa.array(bands, pa.string()), "cosine": pa.array(cosine, mask=founded),
            **nothing(("total", "n", "first", "last", "author", "category", "entities"), len(order))}
        own = np.flatnonzero(changed)
        kept = {
            "kind": pa.array(["cluster"] * len(own), pa.string()), "cluster": pa.array(ids[own]), "total": pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * totals.shape[1]), pa.array(totals[own].ravel())),
            "n": pa.array(n[own]), "first": pa.array(first[own], mask=open_[own]), "last": pa.array(last[own], mask=open_[own]), "author": authors.take(pa.array(own)), "category": categories.take(pa.array(own)),
            "entities": pa.array([sorted(entities(c)) for c in own.tolist()], pa.list_(pa.string())), **nothing(("id", "founded", "band", "cosine"), len(own))}
        return pa.concat_tables([pa.table([part[c] for c in schema.names], schema=schema) for part in (placed, kept)])

    return run


def finished(spark: SparkSession, folder: str) -> int:
    """How many batches the folder holds whole."""
    n = 0
    while exists(spark, f"{folder}/assigned/batch={n}/_SUCCESS"):
        n += 1
    return n


def assignments(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    n = finished(spark, folder) if before is None else before
    if not n:
        return spark.createDataFrame([], ASSIGNED_SCHEMA)
    return spark.read.schema(ASSIGNED_SCHEMA).parquet(*[f"{folder}/assigned/batch={i}" for i in range(n)])


def clusters(spark: SparkSession, folder: str, before: int | None = None, since: int | None = None) -> DataFrame:
    """The clusters as they stand after ``before`` batches: each one's last version. ``since`` leaves out those that ended
    before; a cluster's end only grows, so its last version is among the rows that are read if any is."""
    n = finished(spark, folder) if before is None else before
    if not n:
        return spark.createDataFrame([], CLUSTER_SCHEMA)
    names = [f.name for f in spark.createDataFrame([], CLUSTER_SCHEMA).schema if f.name != "cluster"]
    rows = spark.read.schema(f"{CLUSTER_SCHEMA}, batch int").option("basePath", f"{folder}/clusters").parquet(*[f"{folder}/clusters/batch={i}" for i in range(n)])
    if since is not None:
        rows = rows.where(F.col("last").isNull() | (F.col("last") >= since))
    return rows.groupBy("cluster").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("cluster", "s.*")


def assign_batch(items: DataFrame, folder: str, number: int, policy: Policy = Policy()) -> None:
    """Places the items of batch ``number`` (id, v, t in microseconds, author, category, entities) and writes its part of the
    state. Ids repeated in a batch are one item: the first in the order of time."""
    spark = items.sparkSession
    done = assignments(spark, folder, number).select("id")
    fresh = items.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)).join(done, "id", "left_anti")
    values = ["v", "t", "author", "category", F.coalesce("entities", F.array()).alias("entities")]
    new = keep(fresh.groupBy("id").agg(F.min_by(F.struct(*values), F.struct(F.col("t").isNull(), "t")).alias("s")).select("id", "s.*"))
    start = new.agg(F.min("t")).first()[0]
    undated = not new.where("t IS NULL").isEmpty()
    span, least = int(policy.span_days * DAY), policy.gray**2 - 1e-6
    stored = keep(clusters(spark, folder, number, None if start is None or undated else start - span))
    # what can affect what
    links = tiles.links(new, least, "id", "v", F.col("t"), span + 1)
    if not stored.isEmpty():
        # a time that a cluster can take in lies within the span of the middle of its times
        known = stored.select(F.col("cluster").alias("id"), F.col("total").alias("v"), F.floor((F.col("first") + F.col("last")) / 2).cast("long").alias("t"))
        links = links.unionByName(tiles.links_between(new, known, least, "id", "v", F.col("t"), span + 1))
    links = keep(links)
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    labels = keep(events.connected(links, ends))
    # items without a link found clusters of their own, without a task of their own
    alone = new.join(ends, "id", "left_anti")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    founded = alone.select(
        F.col("id").alias("cluster"), F.transform("v", lambda x: x.cast("double") / size).alias("total"), F.lit(1).cast("long").alias("n"),
        F.col("t").alias("first"), F.col("t").alias("last"), "author", "category", F.sort_array(F.array_distinct("entities")).alias("entities"))
    rows = new.select("id", F.transform("v", lambda x: x.cast("double")).alias("v"), "t", "author", "category", "entities", F.lit(False).alias("stored"), F.lit(1).cast("long").alias("n"), F.col("t").alias("first"), F.col("t").alias("last"))
    before = stored.select(F.col("cluster").alias("id"), F.col("total").alias("v"), F.lit(None).cast("long").alias("t"), "author", "category", "entities", F.lit(True).alias("stored"), "n", "first", "last")
    steps = keep(rows.unionByName(before).join(labels, "id").groupBy("label").applyInArrow(_sequential(policy), _STEP_SCHEMA))
    changed = steps.where("kind = 'cluster'").select(*founded.columns).unionByName(founded)
    placed = steps.where("kind = 'item'").select("id", "cluster", "founded", "band", "cosine")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("band", "string"), ("cosine", "double"))]
    changed.write.mode("overwrite").parquet(f"{folder}/clusters/batch={number}")
    placed.unionByName(alone.select("id", F.col("id").alias("cluster"), F.lit(True).alias("founded"), *none)).write.mode("overwrite").parquet(f"{folder}/assigned/batch={number}")
    discard(new, stored, links, labels, steps)


def cluster_stream(stream: DataFrame, folder: str, policy: Policy = Policy()) -> None:
    """Works off what a stream of items has, one batch of the stream after the other. Called again with the same folder it
    goes on behind the last batch that was finished."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True)
    query = writer.foreachBatch(lambda batch, n: assign_batch(batch, folder, n, policy)).start()
    query.awaitTermination()
