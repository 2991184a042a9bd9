"""Finding stretches that recur anywhere in a corpus: anchors, classes of contexts, and spans to take out.

A stretch is ``length`` consecutive units (bytes or words) of one text. Winnowing picks anchors, grams of ``gram``
units, so that any two equal stretches hold an anchor at the same place. Everything that follows works on anchors:

1. ``anchors``: each anchor with its context, the units that any stretch around it can reach, as two hashes.
2. ``resolve``: anchors meet by gram hash and equal contexts of a gram become a class with one representative. A class
   that stands in several places, or that agrees with another one on half of the units around the gram, as any two with
   a stretch in common must on one side, becomes a detail. A gram with over ``HOT_GRAM`` details is hot.
3. ``contexts``: fetches the texts of the details' representatives.
4. The operators compare details unit by unit and tell which stretches of a class recur; ``find_spans`` brings them to
   all members of the class, ``gather`` to the texts.

Copies join their class in the task that reads them, one per batch goes on, so large groups of copies do not meet in one
task. Repeated rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .textblocks import prefix_hash, span_hash, text_chunks, window_minima

#: Details of one gram that are compared in one task; more are compared stretch by stretch through a shuffle.
HOT_GRAM = 16_384
#: Bytes of pieces that a task hands on at once.
BATCH_BYTES = 4 << 20

#: Cuts a chunk of texts into units: (bytes, offsets) -> (a code for each unit, where each text's units begin).
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

MEMBER, DETAIL = 0, 1

ANCHOR_SCHEMA = "key long, gram long, context long, row long, doc long, lo int, hi int, at int, left int, right int, many boolean"
RESOLVED_SCHEMA = "kind int, gram long, context long, row long, doc long, lo int, hi int, at int, many boolean, hot boolean"
PIECE_SCHEMA = "gram long, context long, row long, doc long, lo int, at int, many boolean, hot boolean, piece binary"
#: What a comparison finds: units lo to hi of a class's context recur, for all its members or (own) those of larger docs.
FOUND_SCHEMA = "gram long, context long, doc long, own boolean, lo int, hi int"


def with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))


def _table(schema: list[tuple[str, pa.DataType]], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


_ANCHOR = [("key", pa.int64()), ("gram", pa.int64()), ("context", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()),
           ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("many", pa.bool_())]
_RESOLVED = [("kind", pa.int32()), ("gram", pa.int64()), ("context", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()),
             ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("many", pa.bool_()), ("hot", pa.bool_())]


def _lesser(at: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the nearest one before and the nearest one after it, less than ``width`` away, whose value is
    less; far off where there is none."""
    n, sides = len(at), []
    for step in (-1, 1):
        near = np.full(n, step * (1 << 60))
        open_, other = np.arange(n), np.arange(n) + step
        while len(open_):
            fits = (other >= 0) & (other < n)
            open_, other = open_[fits], other[fits]
            fits = np.abs(at[other] - at[open_]) < width
            open_, other = open_[fits], other[fits]
            less = value[other] < value[open_]
            near[open_[less]] = at[other[less]]
            open_, other = open_[~less], other[~less] + step
        sides.append(near)
    return sides[0], sides[1]


def text_anchors(codes: np.ndarray, begins: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For all anchors of a chunk: text, gram hash, context hash, lo, hi, at (units from the text's first), and short
    hashes of the units left and right of the gram: a stretch takes in all of the one or of the other."""
    none = np.zeros(0, dtype=np.int64)
    if len(codes) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(np.int32), none.astype(np.int32)
    prefix = prefix_hash(codes)
    starts = np.arange(len(codes) - gram + 1)
    hashes = span_hash(prefix, starts, starts + gram)
    top = np.iinfo(np.uint64).max
    for edge in begins[1:-1]:  # grams may not cross texts
        hashes[max(edge - gram + 1, 0) : edge] = top
    at = window_minima(hashes, length - gram + 1)
    text = np.searchsorted(begins, at, side="right") - 1
    good = (np.diff(begins)[text] >= length) & (hashes[at] != top)
    at, text = at[good], text[good]
    # a stretch belongs to the anchors that are its least grams, so a context ends before a lesser gram is whole
    before, after = _lesser(at, hashes[at], length - gram + 1)
    lo = np.maximum(np.maximum(at - (length - gram), before + 1), begins[text])
    hi = np.minimum(np.minimum(at + length, after + gram - 1), begins[text + 1])
    context = span_hash(prefix, lo, hi) ^ ((at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = begins[text]
    beside = (length - gram) // 2
    # beyond the text's ends nothing can agree, so the context's own hash stands in
    left = np.where(at - beside >= first, span_hash(prefix, np.maximum(at - beside, 0), at), context).astype(np.uint32)
    end = at + gram + beside
    right = np.where(end <= begins[text + 1], span_hash(prefix, at + gram, np.minimum(end, len(codes))), ~context).astype(np.uint32)
    return text, hashes[at], context, lo - first, hi - first, at - first, left.view(np.int32), right.view(np.int32)


def anchors(rows: DataFrame, units: Units, length: int, gram: int, first_only: bool) -> DataFrame:
    """Anchors of all texts. ``first_only``: a stretch of the smallest doc stays; otherwise no copy of it does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            parts = []
            for first, _, data, offsets in text_chunks(batch.column(2)):
                text, *rest = text_anchors(*units(data, offsets), length, gram)
                parts.append([text + first, *rest])
            if not parts:
                continue
            text, grams, context, lo, hi, at, left, right = (np.concatenate(x) for x in zip(*parts))
            if not len(grams):  # texts shorter than a stretch have no anchor
                continue
            row, doc, grams, context = row[text], doc[text], grams.view(np.int64), context.view(np.int64)
            order = np.lexsort((at, row, doc, context, grams))
            grams, context, row, doc, lo, hi, at, left, right = (x[order] for x in (grams, context, row, doc, lo, hi, at, left, right))
            new, size = _groups(grams, context)
            rep = np.zeros(len(grams), dtype=bool)
            rep[new] = True
            last = np.append(new[1:], len(grams)) - 1
            many = np.repeat(doc[last] > doc[new] if first_only else size > 1, size)
            for mask, key in ((rep, grams), (~rep, row)):  # other members travel by row, so that none is crowded
                if mask.any():
                    at_ = at[mask] if key is grams else np.full(mask.sum(), -1)
                    yield _table(_ANCHOR, [key[mask], grams[mask], context[mask], row[mask], doc[mask], lo[mask], hi[mask], at_, left[mask], right[mask], many[mask]])

    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    return rows.select("row", order.alias("doc"), "text").mapInArrow(run, ANCHOR_SCHEMA)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new = np.flatnonzero(new)
    return new, np.diff(np.append(new, n))


def resolve(found: DataFrame, first_only: bool) -> DataFrame:
    """Members of the classes that recur or may do so in part, and one detail for each of these classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got)
        _, grams, context, row, doc, lo, hi, at, left, right, many = (c.to_numpy() for c in table.columns)
        settled = at < 0
        never = np.zeros(len(grams), dtype=bool)

        def out(mask: np.ndarray, kind: int, many: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
            n = int(mask.sum())
            place = (hi[mask], at[mask]) if kind == DETAIL else (np.zeros(n, dtype=np.int32),) * 2  # members need no more than lo
            return _table(_RESOLVED, [np.full(n, kind), *(x[mask] for x in (grams, context, row, doc, lo)), *place, many[mask], hot[mask]])

        yield out(settled, MEMBER, never, never)
        order = np.lexsort((at, row, doc, context, grams))
        order = order[~settled[order]]
        if not len(order):
            return
        grams, context, row, doc, lo, hi, at, left, right, many = (x[order] for x in (grams, context, row, doc, lo, hi, at, left, right, many))
        new, size = _groups(grams, context)  # classes: equal contexts of a gram, the smallest doc first
        last = np.append(new[1:], len(grams)) - 1
        several = np.logical_or.reduceat(many, new) | (doc[last] > doc[new] if first_only else size > 1)
        live = np.zeros(len(new), dtype=bool)
        for side in (left, right):  # classes that agree with another one on this side of the gram
            by = np.lexsort((side[new], grams[new]))
            start, count = _groups(grams[new][by], side[new][by])
            live[by] |= np.repeat(count > 1, count)
        gram_new, gram_size = _groups(grams[new])
        if first_only:  # within one document nothing goes
            low, high = np.minimum.reduceat(doc[new], gram_new), np.maximum.reduceat(doc[last], gram_new)
            live &= np.repeat((low < high) | np.logical_or.reduceat(several, gram_new), gram_size)
        detail = several | live
        hot = np.repeat(np.add.reduceat(detail.astype(np.int64), gram_new) > HOT_GRAM, gram_size)
        mine = np.repeat(detail, size)
        first = np.zeros(len(grams), dtype=bool)
        first[new] = True
        yield out(mine, MEMBER, mine, mine)
        yield out(mine & first, DETAIL, np.repeat(several, size), np.repeat(hot, size))

    return found.repartition("key").mapInArrow(run, RESOLVED_SCHEMA)


def _packed(rows: DataFrame) -> DataFrame:
    """row, doc_id and the text, compressed: texts are what is shuffled most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [press.compress(t.as_buffer()) if len(t.as_buffer()) else b"" for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, type=pa.binary())], names=["row", "doc_id", "packed"])

    return rows.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, doc_id long, packed binary")


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def contexts(rows: DataFrame, details: DataFrame, cut: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]) -> DataFrame:
    """The details with the bytes of their contexts; ``cut`` gives the bytes of units lo to hi of a text."""
    names = ("lo", "hi", "at", "gram", "context", "doc", "many", "hot")
    wanted = details.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("cuts"))
    # rows of one doc_id and text are one document
    texts = _packed(rows).dropDuplicates(["row"]).join(wanted, "row").select("row", "packed", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, packed, cuts = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            offsets = cuts.offsets.to_numpy()
            lo, hi, at, gram, context, doc, many, hot = (x.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] for x in cuts.values.flatten())
            offsets = offsets - offsets[0]
            pieces: list[bytes] = []
            done = size = 0
            for i in range(len(keys)):
                new = cut(unpack(packed[i].as_py()), lo[offsets[i] : offsets[i + 1]], hi[offsets[i] : offsets[i + 1]])
                pieces += new
                size += sum(map(len, new))
                if size > BATCH_BYTES or i + 1 == len(keys):
                    s = slice(offsets[done], offsets[i + 1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram[s]), pa.array(context[s]), pa.array(np.repeat(keys[done : i + 1], np.diff(offsets[done : i + 2]))), pa.array(doc[s]),
                         pa.array(lo[s]), pa.array(at[s]), pa.array(many[s]), pa.array(hot[s]), pa.array(pieces, type=pa.binary())],
                        names=["gram", "context", "row", "doc", "lo", "at", "many", "hot", "piece"],
                    )
                    pieces, done, size = [], i + 1, 0

    return texts.mapInArrow(run, PIECE_SCHEMA)


def found_spans(gram: np.ndarray, context: np.ndarray, doc: np.ndarray, piece: np.ndarray, start: np.ndarray, own: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows of FOUND_SCHEMA: windows of one piece that follow each other closely become one."""
    order = np.lexsort((start, own, piece))
    piece, start, own = piece[order], start[order], own[order]
    new = np.ones(len(piece), dtype=bool)
    new[1:] = (piece[1:] != piece[:-1]) | (own[1:] != own[:-1]) | (start[1:] > start[:-1] + length)
    new = np.flatnonzero(new)
    last = np.append(new[1:], len(piece)) - 1
    which = piece[new]
    return pa.RecordBatch.from_arrays(
        [pa.array(gram[which]), pa.array(context[which]), pa.array(doc[which]), pa.array(own[new]), pa.array(start[new], type=pa.int32()), pa.array(start[last] + length, type=pa.int32())],
        names=["gram", "context", "doc", "own", "lo", "hi"],
    )


def whole_grams(pieces: pa.Table, most: int) -> Iterator[pa.Table]:
    """Slices of about ``most`` rows of a table in order of gram; a gram's rows stay together."""
    gram = pieces.column("gram").to_numpy()
    first = 0
    while first < len(gram):
        last = min(first + most, len(gram))
        if last < len(gram):
            back = int(np.searchsorted(gram, gram[last], side="left"))
            last = back if back > first else int(np.searchsorted(gram, gram[last], side="right"))
        yield pieces.slice(first, last - first)
        first = last


def gather(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """doc_id, packed and spans of every row of ``docs``; spans are null where nothing was found."""
    return _packed(with_row(docs)).join(listed, "row", "left").select("doc_id", "packed", "spans")


def find_spans(
    docs: DataFrame, units: Units, length: int, gram: int, first_only: bool,
    cut: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]], compare: Callable[[DataFrame], DataFrame], compare_hot: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """row and spans (lo, hi), in order, of every text in which something was found."""
    rows = with_row(docs)
    resolved = keep(resolve(anchors(rows, units, length, gram, first_only), first_only))
    pieces = keep(contexts(rows, resolved.where(F.col("kind") == DETAIL), cut))
    found = compare(pieces.where("not hot")).unionByName(compare_hot(pieces.where("hot")))
    members = resolved.where(F.col("kind") == MEMBER).select("gram", "context", "row", F.col("doc").alias("mine"), F.col("lo").alias("first"))
    # a class has few spans, as long as a context is; they travel as one row, and a member takes those that are meant for it.
    # The table between lets Spark split the members of a large class when they are joined.
    classes = keep(found.groupBy("gram", "context").agg(F.collect_list(F.struct("own", "doc", "lo", "hi")).alias("found")))
    mine = F.filter("found", lambda s: ~s["own"] | (F.col("mine") > s["doc"]))
    whole = lambda c: (F.col("first") + c).cast("long")
    ends = F.transform(mine, lambda s: F.shiftleft(whole(s["lo"]), 32) + whole(s["hi"]))  # one number a span
    hit = members.join(classes, ["gram", "context"]).select("row", ends.alias("ends")).where(F.size("ends") > 0)
    listed = hit.groupBy("row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ends")))).alias("ends"))
    span = lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("lo"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("hi"))
    return listed.select("row", F.transform("ends", span).alias("spans"))
