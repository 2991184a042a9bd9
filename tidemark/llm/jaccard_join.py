"""N-gram Jaccard join: candidates from an R-tree over count vectors, links confirmed on whole shingle sets.

A document's set holds its distinct shingles of ``SHINGLE`` lower-cased words. Equal sets are one node. Two nodes
link if 100 * intersection >= ``PERCENT`` * union. Steps:

1. ``heavy_shingles``: shingles of many documents, counted over all of them, go last in the order of shingles. The
   order decides how much work is done, never the result.
2. ``describe``: each document's node, set size, count vector (shingles per hash group) and prefix: two linked sets
   share a shingle among the first ``n - ceil(0.85 n) + 1`` of each, and the first that they share is among the first
   ``n - ceil(2 * 0.85 / 1.85 * n) + 1`` of the smaller one, its index part. Nodes meet in blocks by prefix shingle.
3. ``promising``: an R-tree over a block's count vectors bounds overlaps by summed coordinate minima. A node leaves each
   block that holds no other one with which the bound allows a link, so texts that share a common phrase only are seen
   once and neither in rounds nor in the last step.
4. Rounds: each node takes part in its first few blocks that hold two components or more. In the first round each node
   is paired with one centre that the bound allows or becomes a centre, later on with the nearest node of another
   component. Pairs whose prefixes leave room for enough in common are confirmed on the sets, and components named,
   until a round finds few links. Only texts of such pairs are read again from ``docs`` and shuffled.
5. Blocks whose nodes are still not all connected yield every pair between different components that the bound
   allows, in blocks of the smaller set's index part, so no link between components is missed, and copies never expand
   to all pairs. Blocks of a few nodes take no part in rounds, their pairs are tried here only.

A block with over ``PART_NODES`` nodes is dealt to several tasks, in rounds by node, otherwise each time, and at the
end by pairs of parts that hold different components; no node leaves it.

Null or wordless texts have empty sets and link with nothing; shorter texts have their whole sequence as the one
shingle. Repeated rows share a node. A null doc_id takes no part in naming a component. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dealt_by, discard, free_name, keep, keep_by, most_frequent, table, where_likely
from .repeats import _groups, _packed, unpack, with_row
from .textblocks import mix, prefix_hash, span_hash, text_chunks, word_hashes, words

SHINGLE = 4
PERCENT = 85
#: Hash groups whose counts make a node's point.
DIMENSIONS = 128
#: Share of documents from which a shingle is heavy, and the most heavy shingles sent to executors.
HEAVY_SHARE = 0.001
MOST_HEAVY = 200_000
#: Nodes of a block that one task pairs; larger blocks are dealt to several.
PART_NODES = 20_000
#: Open blocks in which a node takes part in one round, the most rounds, and the share of the first round's links below
#: which a round is the last; the last step sees all blocks.
STAR_BLOCKS = 4
ROUNDS = 4
FEW_LINKS = 0.02
#: Nodes of a block that takes no part in rounds: its few pairs are tried once, in the last step.
SMALL_BLOCK = 4
LEAF, FAN = 16, 16
#: Points of which all pairs are compared at once, which costs less than a tree.
FEW_POINTS = 64


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, sorted distinct shingles of each text in turn, where each text's begin)."""
    for first, end, data, offsets in text_chunks(column):
        starts, ends, begins = words(data, offsets)
        prefix = prefix_hash(word_hashes(data, starts, ends, lower=True))
        n = np.diff(begins)
        counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
        text = np.repeat(np.arange(len(n)), counts)
        at = begins[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes = span_hash(prefix, at, at + np.minimum(n, size)[text])
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        yield first, hashes[new], np.searchsorted(text[new], np.arange(end - first + 1))


def heavy_shingles(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Hashes of shingles in at least HEAVY_SHARE of all documents (and 20); batches report what is frequent in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h for _, h, _ in shingle_sets(batch.column(0), size)]
            hashes, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), return_counts=True)
            often = count >= max(4, HEAVY_SHARE / 2 * batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[often].view(np.int64)), pa.array(count[often], type=pa.int64())], names=["h", "n"])

    least = max(20, HEAVY_SHARE * docs.count())
    sums = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    sums = keep(sums)
    top = most_frequent(sums, "n", MOST_HEAVY).select("h").toPandas()
    discard(sums)
    return np.sort(top["h"].to_numpy(dtype=np.int64).view(np.uint64))


def count_vectors(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    n = len(begins) - 1
    cell = np.repeat(np.arange(n), np.diff(begins)) * DIMENSIONS + (hashes % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS), 2**31 - 1).astype(np.int32)


def index_length(n, percent: int):
    """Of a set's prefix, the shingles among which the first one shared with a larger or equal set must be."""
    whole = (2 * percent * n + 99 + percent) / (100 + percent)
    return n - (F.floor(whole) if isinstance(n, Column) else np.floor(whole).astype(np.int64)) + 1


def packed_vectors(vectors: np.ndarray) -> list[bytes]:
    """One byte a count where all of a node's fit, else four."""
    small = vectors.max(axis=1, initial=0) < 256
    return [v.astype(np.uint8).tobytes() if s else v.tobytes() for v, s in zip(vectors, small)]


def unpacked_vectors(packed: list[bytes]) -> np.ndarray:
    out = np.empty((len(packed), DIMENSIONS), dtype=np.int32)
    small = np.array([len(p) == DIMENSIONS for p in packed], dtype=bool)
    for mask, kind in ((small, np.uint8), (~small, np.int32)):
        out[mask] = np.frombuffer(b"".join(p for p, m in zip(packed, mask) if m), dtype=kind).reshape(-1, DIMENSIONS)
    return out


def describe(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, texts: bool = True) -> DataFrame:
    """row, doc_id, n, node, vector, keys, light, packed; the last four only at the first row of a node in each batch.

    ``packed`` is the compressed text, which weighs a fraction of its shingles (null without ``texts``); ``keys`` are the node's prefix shingles in order, ``light`` says how many of them are not heavy.
    """
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = heavy.value
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            seen: set[int] = set()
            for first, hashes, begins in shingle_sets(batch.column(2), size):
                n = np.diff(begins)
                text = np.repeat(np.arange(len(n)), n)
                total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes))])
                node = mix((total[begins[1:]] - total[begins[:-1]]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                rare = np.ones(len(hashes), dtype=bool)
                if len(last):
                    rare = last[np.minimum(np.searchsorted(last, hashes), len(last) - 1)] != hashes
                order = np.lexsort((hashes, ~rare, text))
                prefix = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                rank = np.arange(len(hashes)) - begins[text]
                keys = hashes[order].view(np.int64)[rank < prefix[text]]
                light = np.minimum(np.bincount(text, weights=rare, minlength=len(n)).astype(np.int64), prefix)
                fresh = np.array([k > 0 and not (d in seen or seen.add(d)) for d, k in zip(node.tolist(), n.tolist())], dtype=bool)
                vectors = iter(packed_vectors(count_vectors(hashes, begins)[fresh]))
                sizes = np.where(fresh, prefix, 0)
                taken = keys[np.repeat(fresh, prefix)]
                end = first + len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(n, type=pa.int64()),
                     pa.array(node, mask=n == 0), pa.array([next(vectors) if f else None for f in fresh], type=pa.binary()),
                     pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(taken)), pa.array(light, type=pa.int32()),
                     pa.array([press.compress(t.as_buffer()) if f and texts else None for t, f in zip(batch.column(2).slice(first, end - first), fresh)], type=pa.binary())],
                    names=["row", "doc_id", "n", "node", "vector", "keys", "light", "packed"],
                )

    return with_row(docs).select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "row long, doc_id long, n long, node long, vector binary, keys array<long>, light int, packed binary"
    )


def blocks(described: DataFrame, percent: int = PERCENT) -> DataFrame:
    """block, node, early: nodes that share a prefix shingle; ``early`` if it is in the node's index part.

    Of shingles that are not heavy, a node without another one in the block whose size and places allow a link is left
    out, and shingles with the same nodes make one block. Heavy ones are blocks as they are. Tasks give a block as one row
    with its nodes, as most shingles of near copies make the same block in many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        key, node, n = (c.to_numpy() for c in pa.Table.from_batches(got).columns)
        n, early = n >> 1, (n & 1).astype(bool)
        order = np.lexsort((node, n, key))
        key, node, n, early = key[order], node[order], n[order], early[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, early = key[new], node[new], n[new], early[new]
        begin, size = _groups(key)
        first = np.repeat(begin, size)
        # the nearest smaller node with the shingle in its index part, and the next larger node
        below = np.concatenate([[-1], np.maximum.accumulate(np.where(early, np.arange(len(key)), -1))[:-1]])
        fits = (below >= first) & (100 * n[below] >= percent * n)
        fits[:-1] |= early[:-1] & (key[1:] == key[:-1]) & (percent * n[1:] <= 100 * n[:-1])
        key, node, early = key[fits], node[fits], early[fits]
        if not len(key):
            return
        begin, size = _groups(key)
        place = mix(node.view(np.uint64) * np.uint64(2) + early.astype(np.uint64))
        block = mix(np.add.reduceat(place, begin) + size.astype(np.uint64)).view(np.int64)
        first = np.zeros(len(begin), dtype=bool)
        first[np.unique(block, return_index=True)[1]] = True
        take = np.repeat(first, size)
        ends = np.concatenate([[0], np.cumsum(size[first])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block[first]), *(pa.ListArray.from_arrays(ends, pa.array(x[take])) for x in (node, early))], names=["block", "node", "early"]
        )

    pairs = described.select("node", "n", "light", F.posexplode("keys").alias("at", "key")).select(
        "key", "node", "n", (F.col("at") < index_length(F.col("n"), percent)).alias("early"), (F.col("at") >= F.col("light")).alias("heavy")
    )
    # most of these rows meet no other one and are only shuffled, so size and ``early`` are one number
    rare = pairs.where("not heavy").select("key", "node", (F.col("n") * 2 + F.col("early").cast("long")).alias("n")).repartition("key").mapInArrow(run, "block long, node array<long>, early array<boolean>")
    light = rare.dropDuplicates(["block"]).select("block", F.explode(F.arrays_zip("node", "early")).alias("member")).select("block", "member.node", "member.early")
    return light.unionByName(pairs.where("heavy").select(F.col("key").alias("block"), "node", "early").distinct())


class CountTree:
    """An R-tree over count vectors, packed in order of set size and then of the first coordinates' sum."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = np.argsort(sizes, kind="stable")
        slabs = np.array_split(slab, max(1, int(np.sqrt(len(slab) / LEAF))))
        half = points[:, : DIMENSIONS // 2].sum(axis=1)
        self.order = np.concatenate([s[np.argsort(half[s], kind="stable")] for s in slabs])
        self.levels = [(points[self.order], sizes[self.order])]
        fan = LEAF
        while len(self.levels[-1][1]) > 1:
            top, least = self.levels[-1]
            at = np.arange(0, len(least), fan)
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at)))
            fan = FAN

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Numbers of the points whose overlap with ``point`` may reach the share."""
        here = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            bound = np.minimum(corner[here], point).sum(axis=1)
            here = here[(100 + percent) * bound >= percent * (least[here] + size)]
            if depth:
                fan = LEAF if depth == 1 else FAN
                here = (here[:, None] * fan + np.arange(fan)).ravel()
                here = here[here < len(self.levels[depth - 1][1])]
        return self.order[here]


def star_pairs(points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of each point with a centre that the bound allows; a point without one becomes a centre.

    Of the points that the bound allows around an open one, the one nearest to their median becomes the centre: near
    copies of one text are nearer to that text than to each other, so its star links a group that theirs would not.
    """
    tree, centre, out = CountTree(points, sizes), np.zeros(len(sizes), dtype=bool), []
    paired = np.zeros(len(sizes), dtype=bool)
    for i in range(len(sizes)):
        while not paired[i]:  # each turn settles a centre at least
            near = tree.search(points[i], sizes[i], percent)
            open_ = near[~paired[near]]
            middle = np.median(points[open_], axis=0)
            c = int(open_[np.abs(points[open_] - middle).sum(axis=1).argmin()])
            if c != i:
                near = tree.search(points[c], sizes[c], percent)
            centre[c] = paired[c] = True
            out += [(c, int(j)) for j in near if not paired[j]]
            paired[near] = True
    return out


def cross_pairs(points: np.ndarray, sizes: np.ndarray, label: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """All pairs of differently labelled points that the bound allows; between two sides where there are two."""
    tree, out = CountTree(points, sizes), []
    two = len(side) and side.min() != side.max()
    kind = side if two else label
    names, number, count = np.unique(kind, return_inverse=True, return_counts=True)
    most = names[count.argmax()]
    for i in np.flatnonzero(kind != most):  # every pair has a point outside the largest label or side
        near = tree.search(points[i], sizes[i], percent)
        near = near[(label[near] != label[i]) & (kind[near] != kind[i]) & ((kind[near] == most) | (near > i))]
        out += [(int(i), int(j)) for j in near]
    return out


def _whole(batches: Iterator[pa.RecordBatch], *keys: str) -> tuple[dict[str, np.ndarray], np.ndarray, list[tuple[int, int]]] | None:
    """A partition's columns and vectors in order of its blocks, and where each block begins and how large it is."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return None
    all_ = pa.Table.from_batches(got)
    columns = {c: all_.column(c).to_numpy(zero_copy_only=False) for c in all_.column_names if c != "vector"}
    order = np.lexsort((columns["node"], columns["n"], *(columns[k] for k in reversed(keys))))
    packed = all_.column("vector").to_pylist()
    points = unpacked_vectors([packed[i] for i in order])
    columns = {c: x[order] for c, x in columns.items()}
    return columns, points, list(zip(*(x.tolist() for x in _groups(*(columns[k] for k in keys)))))


def _node_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = np.zeros(0, dtype=np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b"])


def with_partner(points: np.ndarray, sizes: np.ndarray, early: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which points have another one with which the bound allows a link whose first shared shingle may be the block's."""

    def may(i, j):
        return np.where(sizes[i] == sizes[j], early[i] & early[j], np.where(sizes[i] < sizes[j], early[i], early[j]))

    if len(sizes) <= FEW_POINTS:
        bound = np.minimum(points[:, None], points[None]).sum(axis=2)
        at = np.arange(len(sizes))
        good = ((100 + percent) * bound >= percent * (sizes[:, None] + sizes)) & may(at[:, None], at) & (at[:, None] != at)
        return good.any(axis=1)
    tree, found = CountTree(points, sizes), np.zeros(len(sizes), dtype=bool)
    for i in range(len(sizes)):
        if not found[i]:  # the first of a group of copies finds all of them
            near = tree.search(points[i], sizes[i], percent)
            near = near[(near != i) & may(i, near)]
            found[near] = True
            found[i] = len(near) > 0
    return found


def promising(members: DataFrame, points: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``members`` without the rows of nodes that can link with no other node of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _whole(batches, "block")
        if got is None:
            return
        columns, points, groups = got
        n, early = columns["n"], columns["early"].astype(bool)
        good = np.zeros(len(n), dtype=bool)
        two = np.array([b for b, s in groups if s == 2], dtype=np.int64)
        bound = np.minimum(points[two], points[two + 1]).sum(axis=1)
        # in order of size, so the first of two is not the larger one
        good[two] = ((100 + percent) * bound >= percent * (n[two] + n[two + 1])) & early[two] & (early[two + 1] | (n[two] < n[two + 1]))
        good[two + 1] = good[two]
        for begin, size in groups:
            here = slice(begin, begin + size)
            if size > 2:
                good[here] = with_partner(points[here], n[here], early[here], percent)
        yield pa.RecordBatch.from_arrays([pa.array(columns[c][good]) for c in ("block", "node")] + [pa.array(early[good])], names=["block", "node", "early"])

    # one row for PART_NODES rows of members at the most
    many = F.broadcast(members.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > PART_NODES).select("block"))
    seen = members.join(many, "block", "left_anti").join(points, "node").select("block", "node", "early", "n", "vector")
    left = seen.repartition("block").mapInArrow(run, "block long, node long, early boolean")
    return left.unionByName(members.join(many, "block", "left_semi").select("block", "node", "early"))


def first_blocks(members: DataFrame, most: int) -> DataFrame:
    """block, node and label: a node's first ``most`` blocks, in order of their hashes, which near copies have in common
    for the most part."""
    firsts = members.groupBy("node", "label").agg(F.slice(F.sort_array(F.collect_list("block")), 1, most).alias("firsts"))
    return firsts.select(F.explode("firsts").alias("block"), "node", "label")


def nearest_pairs(points: np.ndarray, sizes: np.ndarray, label: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of each point outside the most common label with the nearest differently labelled one that the bound allows."""
    tree, out = CountTree(points, sizes), []
    names, count = np.unique(label, return_counts=True)
    for i in np.flatnonzero(label != names[count.argmax()]):
        near = tree.search(points[i], sizes[i], percent)
        near = near[label[near] != label[i]]
        if len(near):
            bound = np.minimum(points[near], points[i]).sum(axis=1)
            out.append((int(i), int(near[(bound / (sizes[near] + sizes[i])).argmax()])))
    return out


def round_candidates(members: DataFrame, points: DataFrame, percent: int, turn: int) -> DataFrame:
    """Distinct pairs (a, b) in each node's first blocks: stars in turn 0, else nearest nodes of another component."""
    placed = first_blocks(members, STAR_BLOCKS)
    shared = placed.groupBy("block").agg(F.count("*").alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / PART_NODES))
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts")).cast("int").alias("part")
    dealt = placed.join(shared, "block").select("block", part, "node", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _whole(batches, "block", "part")
        if got is None:
            return
        columns, points, groups = got
        node, n, label = columns["node"], columns["n"], columns["label"]
        two = np.array([b for b, s in groups if s == 2], dtype=np.int64)
        bound = np.minimum(points[two], points[two + 1]).sum(axis=1)
        good = two[((100 + percent) * bound >= percent * (n[two] + n[two + 1])) & (label[two] != label[two + 1])]
        a, b = [node[good]], [node[good + 1]]
        for begin, size in groups:
            here = slice(begin, begin + size)
            if size < 3:
                continue
            pairs = nearest_pairs(points[here], n[here], label[here], percent) if turn else star_pairs(points[here], n[here], percent)
            if pairs:
                i, j = np.array(pairs).T
                a.append(node[begin + i])
                b.append(node[begin + j])
        yield _node_pairs(a, b)

    return dealt.join(points, "node").select("block", "part", "node", "label", "n", "vector").repartition("block", "part").mapInArrow(
        run, "a long, b long"
    ).distinct()


def prefix_codes(keys: str = "keys", light: str = "light") -> Column:
    """A node's prefix as ascending unsigned numbers of 32 bits, heavy shingles last."""
    return F.transform(keys, lambda key, i: (F.shiftrightunsigned(key, 33) - F.when(i >= F.col(light), 1 << 31).otherwise(0)).cast("int"))


def parted(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` of blocks of 2 to SMALL_BLOCK nodes, which wait for the last step, and those of larger ones."""
    sized = members.join(members.groupBy("block").agg(F.count("*").alias("size")).where("size > 1"), "block")
    sized = keep(sized)
    small, large = (keep(sized.where(c).drop("size")) for c in (F.col("size") <= SMALL_BLOCK, F.col("size") > SMALL_BLOCK))
    discard(sized)
    return small, large


def vetted(pairs: DataFrame, heads: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose prefixes leave room for a link: up to where the shorter prefix ends, both sets are known, and of
    what comes after it they can share no more than the smaller rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (n, m, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3)), *(batch.column(c) for c in (4, 5)))):
                x, y = x.values.to_numpy().view(np.uint32), y.values.to_numpy().view(np.uint32)
                end = min(x[-1], y[-1])
                x, y = x[: np.searchsorted(x, end)], y[: np.searchsorted(y, end)]
                unique = np.unique(x)
                both = np.intersect1d(unique, y).size + len(x) - len(unique)
                good[i] = (100 + percent) * (both + min(n - len(x), m - len(y))) >= percent * (n + m)
            yield batch.select([0, 1]).filter(pa.array(good))

    a = heads.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("codes").alias("x"))
    b = heads.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("codes").alias("y"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def cross_candidates(members: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different components, column label, in a block of ``members``."""
    sizes = members.groupBy("block", "label").agg(F.count("*").alias("n")).groupBy("block").agg(
        F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("size")
    )
    main = F.col("label") == F.col("most.label")
    main_parts = F.ceil(F.col("most.n") / PART_NODES).cast("int")
    parts = (main_parts + F.ceil((F.col("size") - F.col("most.n")) / PART_NODES)).cast("int")
    # a block within one task's reach is one part; else the largest component's parts meet all others' parts only
    own = F.when(F.col("size") <= PART_NODES, 0).when(main, F.pmod(F.xxhash64("node"), main_parts)).otherwise(
        main_parts + F.pmod(F.xxhash64("node"), parts - main_parts)
    ).cast("int")
    others = F.when(F.col("size") <= PART_NODES, F.array(F.lit(0))).otherwise(F.sequence(F.when(main, main_parts).otherwise(F.lit(0)), parts - 1))
    dealt = members.join(sizes, "block").select("block", "node", "label", "early", own.alias("side"), F.explode(others).alias("other")).select(
        "block", "node", "label", "early", "side", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _whole(batches, "block", "p", "q")
        if got is None:
            return
        columns, points, groups = got
        node, n, label, early, side = (columns[c] for c in ("node", "n", "label", "early", "side"))
        out_a, out_b = [], []
        for begin, size in groups:
            part = slice(begin, begin + size)
            pairs = cross_pairs(points[part], n[part], label[part], side[part], percent)
            if not pairs:
                continue
            i, j = np.array(pairs).T + begin
            i, j = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
            # the first shingle that both share is in the smaller set's index part
            good = early[i] & (early[j] | (n[i] < n[j]))
            i, j = i[good], j[good]
            # a block that both share earlier need not be such a one, so each of these yields the pair
            out_a.append(node[i])
            out_b.append(node[j])
        yield _node_pairs(out_a, out_b)

    return dealt.join(points, "node").select("block", "p", "q", "side", "node", "label", "early", "n", "vector").repartition("block", "p", "q").mapInArrow(
        run, "a long, b long"
    ).distinct()


def pair_texts(docs: DataFrame, described: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) with the rows that hold their nodes' texts, and these texts by row (named node).

    A node's text is that of its least row. Texts of other rows stay where they are but for the few that
    where_likely() lets through.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = keep(described.select("node", "row").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")))
    packed = _packed(where_likely(with_row(docs), rows, "row")).select(F.col("row").alias("node"), "packed")
    texts = keep_by(node_texts(packed, rows.select(F.col("row").alias("node"))), "node")
    a, b = (rows.select(F.col("node").alias(c), F.col("row").alias(f"row_{c}")) for c in ("a", "b"))
    placed = keep(pairs.join(b, "b").join(a, "a"))
    discard(rows)
    return placed, texts


def node_texts(fresh: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its compressed text for each of ``nodes``; a text is shuffled once, as it lies beside its node already."""
    return dealt_by(fresh.select("node", "packed"), "node").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The pairs whose sets are as alike as asked; ``pairs`` and ``texts`` as pair_texts() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, first, number = np.unique(np.concatenate([part.column(0), part.column(1)]), return_index=True, return_inverse=True)
                packed = [*part.column(2), *part.column(3)]
                texts = pa.array([unpack(packed[i].as_py()) for i in first], type=pa.large_binary()).cast(pa.large_string())
                sets = [s for _, hashes, begins in shingle_sets(texts, size) for s in np.split(hashes, begins[1:-1])]
                for i in range(part.num_rows):
                    x, y = sets[number[i]], sets[number[i + part.num_rows]]
                    both = np.intersect1d(x, y, assume_unique=True).size
                    good[at + i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(good))

    a = texts.select(F.col("node").alias("row_a"), F.col("packed").alias("x"))
    b = texts.select(F.col("node").alias("row_b"), F.col("packed").alias("y"))
    # pairs come back in order of a's row, so neighbours share texts
    return pairs.join(b, "row_b").join(a, "row_a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def still_open(members: DataFrame, named: DataFrame) -> DataFrame:
    """``members`` of the blocks that hold two components at least, with their label; a node by itself is its own."""
    labelled = members.drop("label").join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = labelled.groupBy("block").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("block")
    return keep(labelled.join(several, "block", "left_semi"))


def link_documents(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, n_shingles, component_id (null for empty sets without a doc_id)."""
    whole = keep(describe(docs, percent, size, texts=False).drop("packed"))
    described = keep(whole.select("row", "doc_id", "n", "node"))
    fresh = whole.where("vector is not null")
    members = keep(blocks(fresh, percent))
    nodes = members.select("node").distinct()
    likely = where_likely(fresh, nodes, "node").select("node", "n", "vector", prefix_codes().alias("codes"))
    points = keep_by(
        dealt_by(likely, "node").join(nodes, "node", "left_semi").groupBy("node").agg(
            F.first("n").alias("n"), F.first("vector").alias("vector"), F.first("codes").alias("codes")
        ),
        "node",
    )
    discard(whole)
    vectors, heads = points.select("node", "n", "vector"), points.select("node", "n", "codes")
    every, members = members, keep(promising(members, vectors, percent).withColumn("label", F.col("node")))
    discard(every)
    every, (small, members) = members, parted(members)
    discard(every)

    links = tried = of_node = None
    first = 0

    def confirm(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        fresh_ = keep(candidates if tried is None else candidates.join(tried, ["a", "b"], "left_anti"))
        likely = keep(vetted(fresh_, heads, percent))
        placed, texts = pair_texts(docs, described, likely)
        found = keep(confirmed(placed, texts, percent, size))
        discard(likely, placed, texts)
        return fresh_, found

    for turn in range(ROUNDS):
        pairs, found = confirm(round_candidates(members, vectors, percent, turn))
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        n = found.count()
        if n:
            of_node = keep(components(links).select("node", F.col("component").alias("label")))
            before, members = members, still_open(members, of_node)
            discard(before)
        first = first or n
        if n <= FEW_LINKS * first:
            break
    open_ = small if of_node is None else still_open(small, of_node)
    _, found = confirm(cross_candidates(members.unionByName(open_), vectors, percent))
    of_node = keep(components(links.unionByName(found)).select("node", F.col("component").alias("label")))
    discard(members, points, small, *([] if open_ is small else [open_]))

    # a node's smallest doc_id first, so that copies are not joined twice
    least = described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    grouped = least.join(of_node, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "label").select("node", "component_id")
    return described.select("row", "doc_id", "n", "node").join(named, "node", "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group, the one whose doc_id names it; of repeated rows one stays."""
    name = free_name(docs, "row")
    linked = link_documents(docs, percent, size)
    best = linked.where("doc_id = component_id or component_id is null").select(F.col("row").alias(name)).distinct()
    keyed = docs.withColumn(name, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return keyed.join(best, name, "left_semi").dropDuplicates([name]).drop(name)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
