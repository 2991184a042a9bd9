"""Similarity search over unit vectors by an index of cells.

Centres are fitted on a bounded sample; every vector is then stored in the cell of its nearest centre, in rings by its
angle to that centre, in blocks of a bounded size. A query at angle p from a centre cannot be nearer to a ring of angles
lo to hi than ``max(0, lo - p, p - hi)``, so blocks that this keeps out of reach are never met: search is exact whatever
the sample was, and the sample decides only how much it skips. With ``probes`` a query meets only its nearest cells,
which is approximate and cheaper where vectors lie so evenly that bounds skip little.

Queries meet blocks by an equi-join on the block; cosines of a block are one matrix product inside a task.

Null and zero vectors match nothing, neither as queries nor as stored rows. Ids repeated in the stored rows are rows of
their own. All vectors must have one size; another size is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep

#: Rows that centres are fitted on, rounds of fitting, and the most cells: what the driver holds is bounded by these.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 1024
#: Vectors of a block, queries that meet a block at once, and rings over a quarter turn.
BLOCK, QUERIES, RINGS = 2048, 1024, 24
#: What rounding may take from an angle or a cosine.
SLACK = 1e-7

BLOCK_SCHEMA = "cell int, ring int, part int, ids array<long>, vectors binary"
CHUNK_SCHEMA = "cell int, ring int, part int, ids array<long>, floors array<double>, vectors binary"
HIT_SCHEMA = "q long, s long, cosine double"


@dataclass(frozen=True)
class CellIndex:
    """centres: one row per cell; rings: (cell, ring, lo, hi, parts) of those that have rows; blocks: the stored vectors."""

    centres: np.ndarray
    rings: np.ndarray
    blocks: DataFrame


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-300)


def stacked(column: pa.Array, size: int | None = None) -> np.ndarray:
    """An Arrow column of lists as a matrix in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = size or (len(values) // len(column) if len(column) else 0)
    if len(values) != width * len(column):
        raise ValueError(f"vectors of several sizes, not all of {width}")
    return values.reshape(len(column), width)


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    zero = F.exists(vector, lambda x: (x != 0) & ~F.isnan(x))
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & zero).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))


def fit_centres(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over the ``sample`` rows of the least hashed ids (columns id, v); the same rows give the same centres."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    if len({len(r["v"]) for r in rows}) > 1:
        raise ValueError("vectors of several sizes")
    points = unit(np.array([r["v"] for r in rows], dtype=np.float64))
    centres = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)] if len(points) else np.zeros((0, 1))
    for _ in range(rounds):
        if len(centres) < 2:
            break
        near = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        moved = np.linalg.norm(sums, axis=1) > 0
        centres[moved] = unit(sums[moved])
    return centres


def build(vectors: DataFrame, key: str = "id", vector: str = "v", cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
    """The index of all rows. By default there are about as many cells as blocks in a cell, ``MOST_CELLS`` at the most."""
    usable = _usable(vectors, key, vector)
    wanted = cells or max(1, min(MOST_CELLS, round(math.sqrt(usable.count() / 64))))
    centres = fit_centres(usable, wanted, sample)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = unit(stacked(batch.column(1), shared.value.shape[1]))
            cos = v @ shared.value.T
            cell = np.argmax(cos, axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(v)), cell], -1, 1))
            ring = np.minimum(angle / (math.pi / 2) * RINGS, 2 * RINGS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cell, pa.int32()), pa.array(ring), pa.array(angle), pa.array([x.tobytes() for x in v], pa.binary())], names=["id", "cell", "ring", "angle", "v"])

    placed = keep(usable.mapInArrow(place, "id long, cell int, ring int, angle double, v binary")) if len(centres) else usable.sparkSession.createDataFrame([], "id long, cell int, ring int, angle double, v binary")
    # at most cells times rings rows
    sizes = placed.groupBy("cell", "ring").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rings = np.array(sorted((r.cell, r.ring, r.lo, r.hi, r.parts) for r in sizes.collect()), dtype=np.float64).reshape(-1, 5)
    dealt = placed.join(F.broadcast(sizes.select("cell", "ring", "parts")), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    blocks = dealt.groupBy("cell", "ring", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    packed = blocks.select("cell", "ring", "part", F.transform("rows", lambda r: r["id"]).alias("ids"), F.transform("rows", lambda r: r["v"]).alias("vs"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [b"".join(x.as_py() for x in vs.values) for vs in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(joined, pa.binary())], names=["cell", "ring", "part", "ids", "vectors"])

    return CellIndex(centres, rings, keep(packed.mapInArrow(pack, BLOCK_SCHEMA)))


def _chunks(queries: DataFrame, index: CellIndex, wanted) -> DataFrame:
    """Rows of CHUNK_SCHEMA: the queries (id, v, floor) of a batch that may find something in a block.

    ``wanted(cosines to centres, angle bounds of rings, floors)`` tells which queries meet which rings.
    """
    if not len(index.rings):
        return queries.sparkSession.createDataFrame([], CHUNK_SCHEMA)
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.rings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, rings = shared.value
        cell, ring, parts = (rings[:, i].astype(np.int64) for i in (0, 1, 4))
        for batch in batches:
            for first in range(0, batch.num_rows, QUERIES):
                some = batch.slice(first, QUERIES)
                ids, v, floors = some.column(0).to_numpy(), unit(stacked(some.column(1), centres.shape[1])), some.column(2).to_numpy()
                cos = v @ centres.T
                angle = np.arccos(np.clip(cos, -1, 1))[:, cell]
                apart = np.maximum(np.maximum(rings[:, 2] - angle, angle - rings[:, 3]), 0)
                meets = wanted(cos, apart, floors, cell)
                out: list[tuple] = []
                for r in np.flatnonzero(meets.any(axis=0)):
                    who = np.flatnonzero(meets[:, r])
                    packed = (ids[who], floors[who], v[who].tobytes())
                    out += [(cell[r], ring[r], p, *packed) for p in range(parts[r])]
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=["cell", "ring", "part", "ids", "floors", "vectors"])

    return queries.mapInArrow(run, CHUNK_SCHEMA)


def _hits(chunks: DataFrame, index: CellIndex, k: int | None) -> DataFrame:
    """q, s, cosine of what chunks find in their blocks: all of at least the query's floor, or the best ``k`` of a block."""
    width = index.centres.shape[1]
    stored = index.blocks.select("cell", "ring", "part", F.col("ids").alias("own"), F.col("vectors").alias("stored"))
    # the size of chunks is guessed from the queries, though each goes to many blocks: neither side is sent through the driver
    met = chunks.hint("merge").join(stored, ["cell", "ring", "part"]).select("ids", "floors", "vectors", "own", "stored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, floors, s = (batch.column(c)[i].values.to_numpy() for c in (0, 1, 3))
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.float64).reshape(-1, width) for c in (2, 4))
                cos = a @ b.T
                x, y = np.nonzero(cos >= floors[:, None] - SLACK)
                near = cos[x, y]
                if k is not None:
                    order = np.lexsort((s[y], -np.round(near, 9), x))
                    x, y, near = x[order], y[order], near[order]
                    begins = np.searchsorted(x, np.arange(len(q)))
                    good = np.arange(len(x)) - begins[x] < k
                    x, y, near = x[good], y[good], near[good]
                yield pa.RecordBatch.from_arrays([pa.array(q[x]), pa.array(s[y]), pa.array(near)], names=["q", "s", "cosine"])

    return met.mapInArrow(run, HIT_SCHEMA)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc(F.round("cosine", 9)), "s")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_cells(probes: int):
    def wanted(cos: np.ndarray, apart: np.ndarray, floors: np.ndarray, cell: np.ndarray) -> np.ndarray:
        place = np.argsort(np.argsort(-cos, axis=1, kind="stable"), axis=1)
        return (place[:, cell] < probes) & (np.cos(apart) >= floors[:, None] - SLACK)

    return wanted


def _further_cells(probes: int):
    def wanted(cos: np.ndarray, apart: np.ndarray, floors: np.ndarray, cell: np.ndarray) -> np.ndarray:
        place = np.argsort(np.argsort(-cos, axis=1, kind="stable"), axis=1)
        return (place[:, cell] >= probes) & (np.cos(apart) >= floors[:, None] - SLACK)

    return wanted


def _within_reach(cos: np.ndarray, apart: np.ndarray, floors: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return np.cos(apart) >= floors[:, None] - SLACK


def top_k(queries: DataFrame, index: CellIndex, k: int, least: float, key: str = "id", vector: str = "v", probes: int | None = None) -> DataFrame:
    """q, s, cosine, rank: for each query the ``k`` stored vectors of the largest cosine (to nine digits, ties by id) that is
    ``least`` or more. Query ids must differ.

    Exact by default: the nearest cell gives each query a floor, its k-th best so far, and only rings that can hold
    something better are met then. With ``probes``, as many nearest cells and nothing else.
    """
    wanted = keep(_usable(queries, key, vector).withColumn("floor", F.lit(float(least))))
    near = keep(_best(_hits(_chunks(wanted, index, _nearest_cells(probes or 1)), index, k), k))
    if probes is None:
        full = near.groupBy("q").agg(F.count("*").alias("_n"), F.min("cosine").alias("_least")).where(F.col("_n") >= k)
        raised = wanted.join(full.withColumnRenamed("q", "id"), "id", "left").select("id", "v", F.greatest("floor", F.col("_least") - SLACK).alias("floor"))
        further = _hits(_chunks(raised, index, _further_cells(1)), index, k)
        near = _best(near.drop("rank").unionByName(further), k)
    return near.where(F.col("cosine") >= least)


def pairs(queries: DataFrame, index: CellIndex, least: float, key: str = "id", vector: str = "v") -> DataFrame:
    """q, s, cosine: all stored vectors with a cosine of ``least`` or more to each query, itself included where it is stored."""
    wanted = _usable(queries, key, vector).withColumn("floor", F.lit(float(least)))
    return _hits(_chunks(wanted, index, _within_reach), index, None).where(F.col("cosine") >= least)
