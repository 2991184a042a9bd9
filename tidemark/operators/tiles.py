"""Exact work on all pairs of vectors, tile against tile.

Vectors are dealt into stripes of a bounded size, and a task multiplies two stripes. It does so in single precision, which
tells all but what lies within rounding of a bound; only what may reach the bound is worked out in double precision. No
vector goes to more tiles than there are stripes, and nothing but what is found becomes rows: pairs, a forest of them, sums
or the best of a query. Work is the product of both sides, as it must be where vectors lie so evenly that no bound skips
anything; ``cells`` skips what bounds allow where vectors lie in clusters.

Null and zero vectors, null ids and null groups meet nothing. Vectors of different sizes don't meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep

#: Vectors of a stripe at the most and at the least, and the stripes of an input that lies between.
MOST, LEAST, STRIPES = 65_536, 1024, 16
#: Rows and columns that are multiplied at once.
ROWS, COLUMNS = 1024, 4096
#: Hits of a block of queries that are held before all but the best go.
MANY = 1_000_000
#: What stands for a null mark.
NO_MARK = -(2**63)

Found = Callable[..., Iterator[pa.RecordBatch]]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of each row as the bytes of doubles or floats, whichever they are."""
    for batch in batches:
        kind = batch.column(2).type.value_type.to_pandas_dtype()
        packed = [x.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary()), *batch.columns[3:]], names=["id", "mark", "v", "width", "kind"])


def stripes(vectors: DataFrame, key: str, vector: str, group: str | None = None, mark: Column | None = None) -> tuple[DataFrame, str]:
    """A kept table of (kind, part, parts, width, ids, marks, vectors), and the type of its numbers. A kind is a group and a size."""
    number = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    whole = F.exists(vector, lambda x: (x != 0) & ~F.isnan(x)) & F.col(key).isNotNull() & F.lit(True if group is None else F.col(group).isNotNull())
    kind = F.concat_ws(":", F.size(vector).cast("string"), *([F.col(group).cast("string")] if group else []))
    rows = vectors.where(whole).select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.lit(NO_MARK) if mark is None else mark.cast("long"), F.lit(NO_MARK)).alias("mark"),
        F.transform(vector, lambda x: F.coalesce(x, F.lit(float("nan"))).cast(number)).alias("v"), F.size(vector).alias("width"), kind.alias("kind"))
    packed = keep(rows.mapInArrow(_packed, "id long, mark long, v binary, width int, kind string"))
    sizes = packed.groupBy("kind").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    most = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(F.col("total") / STRIPES)))
    dealt = packed.join(sizes.join(total).select("kind", F.ceil(F.col("n") / most).cast("int").alias("parts")), "kind")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    listed = dealt.groupBy("kind", "part", "parts", "width").agg(F.collect_list(F.struct("id", "mark", "v")).alias("rows"))
    names = [F.col(f"rows.{n}").alias(n) for n in ("id", "mark", "v")]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [b"".join(x.as_py() for x in vs.values) for vs in batch.column(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(whole, pa.large_binary()).cast(pa.binary())], names=["kind", "part", "parts", "width", "ids", "marks", "vectors"])

    schema = "kind string, part int, parts int, width int, ids array<long>, marks array<long>, vectors binary"
    return keep(listed.select("kind", "part", "parts", "width", *names).mapInArrow(join, schema)), number


class Stripe:
    """One side of a tile: ids, marks, vectors as they came, their squares' sums, and unit vectors in single precision."""

    def __init__(self, ids: pa.Scalar, marks: pa.Scalar, vectors: pa.Scalar, width: int, number: str) -> None:
        self.ids, self.marks = ids.values.to_numpy(), marks.values.to_numpy()
        self.raw = np.frombuffer(vectors.as_buffer(), dtype=np.float32 if number == "float" else np.float64).reshape(-1, width)
        self.squares, self.unit = np.zeros(len(self.raw)), np.zeros((len(self.raw), width), np.float32)
        for i in range(0, len(self.raw), ROWS):
            v = self.raw[i : i + ROWS].astype(np.float64)
            self.squares[i : i + ROWS] = np.einsum("ij,ij->i", v, v)
            self.unit[i : i + ROWS] = v / np.sqrt(np.maximum(self.squares[i : i + ROWS, None], 1e-300))


def exact(a: Stripe, x: np.ndarray, b: Stripe, y: np.ndarray) -> np.ndarray:
    """Cosines in double precision; exactly 1 between equal vectors."""
    out = np.empty(len(x))
    for i in range(0, len(x), 65_536):
        some = slice(i, i + 65_536)
        dots = np.einsum("ij,ij->i", a.raw[x[some]].astype(np.float64), b.raw[y[some]].astype(np.float64))
        out[some] = dots / np.sqrt(a.squares[x[some]] * b.squares[y[some]])
    return out


def rounding(width: int) -> float:
    """What single precision may take from a cosine."""
    return (width + 16) * 1.2e-7


def near(a: Stripe, b: Stripe, same: bool, least: float, done: Callable[[slice, slice], bool] = lambda rows, columns: False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a, places in b and cosines in single precision of what may have a cosine of ``least``; within one stripe each
    pair once. Rows and columns that are ``done`` with each other are not multiplied."""
    least = np.float32(least - rounding(a.raw.shape[1]))
    for r in range(0, len(a.raw), ROWS):
        rows = a.unit[r : r + ROWS]
        for c in range(r if same else 0, len(b.raw), COLUMNS):
            if done(slice(r, r + ROWS), slice(c, c + COLUMNS)):
                continue
            cos = rows @ b.unit[c : c + COLUMNS].T
            at = np.flatnonzero(cos >= least)
            x, y = np.divmod(at, cos.shape[1])
            value = cos.ravel()[at]
            x, y = x + r, y + c
            if same and c < r + len(rows):
                once = x < y
                x, y, value = x[once], y[once], value[once]
            if len(x):
                yield x, y, value


def _tiles(left: DataFrame, right: DataFrame, of: Column, run: Callable, schema: str, number: str, other: str) -> DataFrame:
    """``run(a, b, whether it is one stripe)`` over the pairs of stripes of a kind; ``of`` lists the parts of the right that a left one meets."""
    a = left.select("kind", F.col("part").alias("i"), "width", F.col("ids").alias("ia"), F.col("marks").alias("ma"), F.col("vectors").alias("va"), F.explode(of).alias("j"))
    grid = right.select(F.col("kind").alias("k"), F.col("part").alias("p"), F.col("ids").alias("ib"), F.col("marks").alias("mb"), F.col("vectors").alias("vb"))
    # never sent to all tasks: either side may be most of the input
    met = a.hint("merge").join(grid, (F.col("kind") == F.col("k")) & (F.col("j") == F.col("p"))).select("ia", "ma", "va", "ib", "mb", "vb", "width", (F.col("i") == F.col("j")).alias("same"))
    met = met.repartition(F.xxhash64("va"), F.xxhash64("vb"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ia, ma, va, ib, mb, vb, width, same = (c[n] for c in batch.columns)
                x, y = Stripe(ia, ma, va, width.as_py(), number), Stripe(ib, mb, vb, width.as_py(), other)
                yield from run(x, y, same.as_py())

    return met.mapInArrow(work, schema)


def _halves(table: DataFrame, run: Callable, schema: str, number: str) -> DataFrame:
    """Every stripe with itself and, once, with each other one of its kind; each stripe leads in as many tiles as the next."""
    half = F.col("parts") / 2
    steps = F.filter(F.sequence(F.lit(0), F.floor(half).cast("int")), lambda s: (s < half) | (F.col("part") < half) | (s == 0))
    return _tiles(table, table, F.transform(steps, lambda s: F.pmod(F.col("part") + s, F.col("parts")).cast("int")), run, schema, number, number)


def pairs(vectors: DataFrame, least: float, key: str, vector: str) -> DataFrame:
    """a, b, cosine: all pairs of different ids (a < b) with a cosine of ``least`` or more."""

    def run(a: Stripe, b: Stripe, same: bool) -> Iterator[pa.RecordBatch]:
        for x, y, _ in near(a, b, same, least):
            cos = exact(a, x, b, y)
            good = (cos >= least) & (a.ids[x] != b.ids[y])
            p, q = a.ids[x[good]], b.ids[y[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(cos[good])], names=["a", "b", "cosine"])

    table, number = stripes(vectors, key, vector)
    return _halves(table, run, "a long, b long, cosine double", number)


def _lowest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n places the lowest one that links x-y connect it with."""
    root = np.arange(n)
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return root


def _forest(a: Stripe, b: Stripe, same: bool, least: float, within: int | None = None) -> Iterator[pa.RecordBatch]:
    """a, b: of a tile's links as many as connect what they connect. Marks of both ends lie ``within`` of each other, or one is null."""
    n = len(a.ids) if same else len(a.ids) + len(b.ids)
    root, shift = np.arange(n), 0 if same else len(a.ids)

    def one(rows: slice, columns: slice) -> bool:
        x, y = root[rows], root[shift:][columns]
        return (x == x[0]).all() and (y == x[0]).all()

    for x, y, _ in near(a, b, same, least, one):
        u, w = root[x], root[y + shift]
        open_ = u != w  # what is connected already needs no look
        if within is not None:
            p, q = a.marks[x], b.marks[y]
            open_ &= (p == NO_MARK) | (q == NO_MARK) | (np.abs(p - q) <= within)
        x, y, u, w = x[open_], y[open_], u[open_], w[open_]
        good = exact(a, x, b, y) >= least
        if good.any():
            root = _lowest(n, u[good], w[good])[root]
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    joined = np.flatnonzero(root != np.arange(n))
    yield pa.RecordBatch.from_arrays([pa.array(ids[root[joined]]), pa.array(ids[joined])], names=["a", "b"])


def links(vectors: DataFrame, least: float, key: str, vector: str, mark: Column | None = None, within: int | None = None) -> DataFrame:
    """a, b: of the pairs with a cosine of ``least`` or more as many as connect what they connect; of a tile at most one for each
    of its vectors. With ``within`` only pairs count whose whole marks lie no further apart, or of which one is null."""
    table, number = stripes(vectors, key, vector, mark=mark)
    return _halves(table, lambda a, b, same: _forest(a, b, same, least, within), "a long, b long", number).where("a <> b")


def links_between(left: DataFrame, right: DataFrame, least: float, key: str, vector: str, mark: Column | None = None, within: int | None = None) -> DataFrame:
    """The same for pairs of one side with the other; ids of both sides differ."""
    (first, number), (second, other) = stripes(left, key, vector, mark=mark), stripes(right, key, vector, mark=mark)
    many = second.select("kind", F.col("parts").alias("of")).distinct()
    run = lambda a, b, same: _forest(a, b, False, least, within)
    return _tiles(first.join(many, "kind"), second, F.sequence(F.lit(0), F.col("of") - 1), run, "a long, b long", number, other).where("a <> b")


def counts(vectors: DataFrame, bounds: list[float], key: str, vector: str, group: str | None = None, mark: str | None = None) -> DataFrame:
    """kind, bin, n, same: how many pairs of different ids (of one ``group``) have a cosine from ``bounds[bin]`` up to the next
    of the rising bounds, and how many of those agree in ``mark``. A task counts its tile; no pair becomes a row."""
    edges = np.array(bounds)

    def run(a: Stripe, b: Stripe, same: bool) -> Iterator[pa.RecordBatch]:
        n, alike, slack = np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int64), rounding(a.raw.shape[1])
        for x, y, value in near(a, b, same, float(edges[0])):
            cos = value.astype(np.float64)
            at = np.searchsorted(edges, cos, side="right")
            unsure = np.flatnonzero((np.searchsorted(edges, cos - slack, side="right") != at) | (np.searchsorted(edges, cos + slack, side="right") != at))
            at[unsure] = np.searchsorted(edges, exact(a, x[unsure], b, y[unsure]), side="right")
            good = (at > 0) & (a.ids[x] != b.ids[y])
            n += np.bincount(at[good] - 1, minlength=len(edges))
            if mark:
                agree = good & (a.marks[x] == b.marks[y]) & (a.marks[x] != NO_MARK)
                alike += np.bincount(at[agree] - 1, minlength=len(edges))
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), a.marks[0])), pa.array(has.astype(np.int32)), pa.array(n[has]), pa.array(alike[has])], names=["mark", "bin", "n", "same"])

    table, number = stripes(vectors, key, vector, group, F.col(mark or group) if mark or group else None)
    found = _halves(table, run, "mark long, bin int, n long, same long", number)
    return found.groupBy(*(["mark"] if group and not mark else []), "bin").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float, key: str, vector: str) -> DataFrame:
    """q, s, cosine, rank: for each query the ``k`` vectors of the largest cosine (to nine digits, ties by id) that is ``least``
    or more. The first columns of a tile give each query a floor, and only what reaches it is looked at behind them."""

    def run(a: Stripe, b: Stripe, same: bool) -> Iterator[pa.RecordBatch]:
        slack = np.float32(2 * rounding(a.raw.shape[1]) + 1e-8)

        def best(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            cosine = exact(a, x, b, y)
            order = np.lexsort((b.ids[y], -np.round(cosine, 9), x))
            x, y, cosine = x[order], y[order], cosine[order]
            good = (np.arange(len(x)) - np.searchsorted(x, x) < k) & (cosine >= least)
            return x[good], y[good], cosine[good]

        for r in range(0, len(a.raw), ROWS):
            rows = a.unit[r : r + ROWS]
            floor, hits = np.full(len(rows), least, np.float32), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for c in range(0, len(b.raw), COLUMNS):
                cos = rows @ b.unit[c : c + COLUMNS].T
                if not c and cos.shape[1] >= k:
                    floor = np.maximum(floor, np.partition(cos, cos.shape[1] - k, axis=1)[:, -k])
                x, y = np.divmod(np.flatnonzero(cos >= floor[:, None] - slack), cos.shape[1])
                hits.append((x + r, y + c))
                if sum(len(x) for x, _ in hits) > MANY:  # equal vectors reach any floor
                    hits = [best(*map(np.concatenate, zip(*hits)))[:2]]
            x, y, cosine = best(*map(np.concatenate, zip(*hits)))
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[x]), pa.array(b.ids[y]), pa.array(cosine)], names=["q", "s", "cosine"])

    (asked, number), (stored, other) = stripes(queries, key, vector), stripes(vectors, key, vector)
    many = stored.select("kind", F.col("parts").alias("of")).distinct()
    found = _tiles(asked.join(many, "kind"), stored, F.sequence(F.lit(0), F.col("of") - 1), run, "q long, s long, cosine double", number, other)
    order = Window.partitionBy("q").orderBy(F.desc(F.round("cosine", 9)), "s")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
