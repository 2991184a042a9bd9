"""Substring dedup on bytes: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

Every byte that lies in a string of ``LENGTH`` bytes which also starts elsewhere, in any document, is removed.
``repeats`` gives one representative for each class of equal contexts of an anchor. They are compared here: longer and
longer cores around the anchor are hashed, and those that no other context can match and that stand in one place only
are left out; what is left is written as short strings with the core as one letter, split into shards, and each
shard's Burrows-Wheeler transform is built. The transforms are merged by refining the
interleave of the shards, one letter a step: a stable counting pass moves every suffix behind the letter that
precedes it. Suffixes that are not told apart after as many steps as a string has letters share it, so common
prefixes and repeated intervals come out of the steps, and no suffix of the merged text is sorted again. Grams with
very many details (``repeats.HOT_GRAM``) are compared by a digest of each string through a shuffle instead.

Null texts are empty. Texts of fewer than LENGTH bytes stay whole. Repeated rows are copies of each other. Columns
beside doc_id and text are kept by ``drop_repeats``. Where a cut would leave part of a UTF-8 character,
``drop_repeats`` leaves out that part; the digests of the query are taken of the exact bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import free_name, table
from .textblocks import byte_codes, gram_hashes, prefix_hash, span_hash

LENGTH = 200
GRAM = 100
#: Contexts that are compared at once, but for a single gram with more.
SHARD_CONTEXTS = 8_000
#: Shards whose transforms are merged at once, at least, and letters of one shard and of one merge.
SHARDS = 4
SHARD_LETTERS = 1 << 16
MERGE_LETTERS = 250_000
#: Times that cores are lengthened by half of what is left of a string.
NARROWINGS = 3

# bytes that UTF-8 never uses
_END, _CORE, _PAD = 0xFD, 0xFE, 0xFF
_DIGITS = 250


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_codes(data), offsets


def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    return [text[a:b] for a, b in zip(lo.tolist(), hi.tolist())]


def shard_transform(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of the rotations of equally long, distinct strings: letters and rotation numbers."""
    m, size = strings.shape
    rank = strings.astype(np.uint16 if m * size <= SHARD_LETTERS else np.int64)
    step = 1
    while True:
        # by what stands a step further on, then by what stands here: numbers of 16 bits are sorted by counting
        flat, after = rank.ravel(), np.roll(rank, -step, axis=1).ravel()
        order = np.argsort(after, kind="stable")
        order = order[np.argsort(flat[order], kind="stable")]
        a, b = flat[order], after[order]
        new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        numbers = np.empty(m * size, dtype=rank.dtype)
        numbers[order] = new
        rank, step = numbers.reshape(m, size), step * 2
        if step >= size or new[-1] + 1 == m * size:
            return np.roll(strings, 1, axis=1).ravel()[order], order


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray]], letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges transforms by interleave refinement. Returns, in merged order, (entry, block): entries number the
    rotations of all shards in turn; entries of one block share their first ``letters`` letters."""
    sizes = [len(order) for _, order in shards]
    text = np.concatenate([t for t, _ in shards])
    shard = np.repeat(np.arange(len(shards), dtype=np.uint8), sizes)
    block = np.zeros(len(text), dtype=np.int32)
    letter = np.empty_like(text)
    for _ in range(letters):
        # the n-th entry of a shard in the interleave is the n-th of its transform
        letter[np.argsort(shard, kind="stable")] = text
        moved = np.argsort(letter, kind="stable")
        shard, letter_, block_ = shard[moved], letter[moved], block[moved]
        new = np.zeros(len(text), dtype=np.int32)
        new[1:] = (letter_[1:] != letter_[:-1]) | (block_[1:] != block_[:-1])
        block = np.cumsum(new, dtype=np.int32)
    entry = np.empty(len(text), dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    entry[np.argsort(shard, kind="stable")] = np.concatenate([order + b for (_, order), b in zip(shards, base)])
    return entry, block


def _narrowed(data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, many: np.ndarray, length: int, gram: int, narrowings: int):
    """Yields arrays (context, core start, core hash) of the cores that two contexts share, and the units left around them."""
    prefix = prefix_hash(byte_codes(data))
    context, start, size, left = np.arange(len(at)), begin + at, gram, length - gram
    for _ in range(narrowings):
        more = left // 2
        if not more:
            break
        lows = start - more >= begin[context]
        highs = start + size + more <= end[context]
        context, start = np.concatenate([context[lows], context[highs]]), np.concatenate([start[lows] - more, start[highs]])
        size, left = size + more, left - more
        core = span_hash(prefix, start, start + size)
        _, which, count = np.unique(core, return_inverse=True, return_counts=True)
        shared = (count[which] > 1) | many[context]
        context, start = context[shared], start[shared]
    core = span_hash(prefix, start, start + size)
    return context, start, core, size, left


def repeated_windows(pieces: list[bytes], at: np.ndarray, origin: np.ndarray, many: np.ndarray, length: int = LENGTH, gram: int = GRAM,
                     narrowings: int = NARROWINGS, shards: int = SHARDS, merge_letters: int = MERGE_LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start): the strings of ``length`` bytes around the anchors that occur at two origins.

    ``origin``: a number for each piece's first byte such that equal places of a text have equal numbers and other
    texts' places are far off. ``many``: the whole piece occurs elsewhere too.
    """
    ends = np.cumsum([len(p) for p in pieces])
    begin = ends - np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    context, start, core, size, left = _narrowed(data, begin, ends, at, many, length, gram, narrowings)
    none = np.zeros(0, dtype=np.int64)
    if not len(context):
        return none, none
    order = np.argsort(core, kind="stable")
    context, start, core = context[order], start[order], core[order]
    number = np.concatenate([[0], np.cumsum(core[1:] != core[:-1])])
    width = 2 * left + 5
    padded = np.concatenate([np.full(left, _PAD, dtype=np.uint8), data, np.full(left + 1, _PAD, dtype=np.uint8)])
    found_piece, found_start = [none], [none]
    first = 0
    while first < len(context):
        # whole cores go together; a core has at most HOT_GRAM contexts
        last = min(first + max(merge_letters // width, 2), len(context))
        if last < len(context):
            back = int(np.searchsorted(number, number[last], side="left"))
            last = back if back > first else int(np.searchsorted(number, number[last], side="right"))
        c, s, n = context[first:last], start[first:last], number[first:last] - number[first]
        first = last
        strings = np.empty((len(c), width), dtype=np.uint8)
        offsets = np.arange(left)
        strings[:, :left] = padded[s[:, None] + offsets]
        strings[:, :left][s[:, None] - left + offsets < begin[c][:, None]] = _PAD
        strings[:, left] = _CORE
        for k in range(3):
            strings[:, left + 1 + k] = n // _DIGITS**k % _DIGITS
        strings[:, left + 4 : -1] = padded[left + (s + size)[:, None] + offsets]
        strings[:, left + 4 : -1][(s + size)[:, None] + offsets >= ends[c][:, None]] = _PAD
        strings[:, -1] = _END
        distinct, which, copies = np.unique(strings.view(f"V{width}").ravel(), return_inverse=True, return_counts=True)
        table_ = distinct.view(np.uint8).reshape(-1, width)
        # where the core of each distinct string stands; a string with several such places recurs as it is
        here = origin[c] + (s - begin[c])
        low, high = np.full(len(copies), np.iinfo(np.int64).max), np.full(len(copies), np.iinfo(np.int64).min)
        np.minimum.at(low, which, here)
        np.maximum.at(high, which, here)
        multiple = low != high
        np.logical_or.at(multiple, which, many[c])
        most = max(shards, -(-len(table_) * width // (SHARD_LETTERS - width)))
        parts = [x for x in np.array_split(np.arange(len(table_)), min(most, len(table_))) if len(x)]
        entry, block = merge_transforms([shard_transform(table_[x]) for x in parts], left + 4)
        row, offset = np.divmod(entry, width)
        inside = offset <= left
        row, offset, block = row[inside], offset[inside], block[inside]
        # windows may not take in padding
        full = (table_[row, offset] != _PAD) & (table_[row, offset + left + 3] != _PAD)
        row, offset, block = row[full], offset[full], block[full]
        if not len(row):
            continue
        new, count = repeats._groups(block)
        place = low[row] + offset
        several = (np.minimum.reduceat(place, new) != np.maximum.reduceat(place, new)) | np.logical_or.reduceat(multiple[row], new)
        hit = np.repeat(several, count)
        row, offset = row[hit], offset[hit]
        # back from distinct strings to all contexts that read so
        by = np.argsort(which, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(copies)])
        times = copies[row]
        flat = by[np.repeat(bounds[row], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        found_piece.append(c[flat])
        found_start.append(s[flat] - begin[c[flat]] - left + np.repeat(offset, times))
    return np.concatenate(found_piece), np.concatenate(found_start)


def compare(pieces: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        all_ = pa.Table.from_batches(got)
        all_ = all_.take(pa.array(np.argsort(all_.column("gram").to_numpy(), kind="stable")))
        for part in repeats.whole_grams(all_, SHARD_CONTEXTS):
            grams, context, row, doc, lo, at, many = (part.column(n).to_numpy() for n in ("gram", "context", "row", "doc", "lo", "at", "many"))
            _, number = np.unique(row, return_inverse=True)
            origin = number.astype(np.int64) * (1 << 32) + lo
            piece, start = repeated_windows(part.column("piece").to_pylist(), (at - lo).astype(np.int64), origin, many, length, gram)
            if len(piece):
                yield repeats.found_spans(grams, context, doc, piece, start, np.zeros(len(piece), dtype=bool), length)

    return pieces.select("gram", "context", "row", "doc", "lo", "at", "many", "piece").repartition("gram").mapInArrow(run, repeats.FOUND_SCHEMA)


def compare_hot(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same for grams with very many details: each string's hash meets its like through a shuffle."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(6)).to_numpy())
            data = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint8)
            for i in range(0, len(ends), 1000):
                j = min(i + 1000, len(ends))
                base = ends[i - 1] if i else 0
                digest, bounds = gram_hashes(byte_codes(data[base : ends[j - 1]]), np.concatenate([[0], ends[i:j] - base]), length)
                gram, context, row, doc, first, many = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False)[i:j], np.diff(bounds)) for k in range(6))
                lo = np.arange(len(row)) - np.repeat(bounds[:-1], np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(digest.view(np.int64)), pa.array(context), pa.array(row), pa.array(doc), pa.array((first + lo).astype(np.int32)), pa.array(many), pa.array(lo.astype(np.int32))],
                    names=["gram", "digest", "context", "row", "doc", "place", "many", "lo"],
                )

    each = pieces.select("gram", "context", "row", "doc", "lo", "many", "piece").mapInArrow(
        windows, "gram long, digest long, context long, row long, doc long, place int, many boolean, lo int"
    )
    place = F.struct("row", "place")
    twice = each.groupBy("gram", "digest").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("many").alias("many")).where("many or a <> b")
    return each.drop("many").join(twice, ["gram", "digest"]).select("gram", "context", "doc", F.lit(False).alias("own"), "lo", (F.col("lo") + length).alias("hi")).distinct()


def repeat_spans(docs: DataFrame) -> DataFrame:
    return repeats.find_spans(docs, units, LENGTH, GRAM, False, cut, compare, compare_hot)


def united(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["hi"])
        else:
            out.append([s["lo"], s["hi"]])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for s in spans for e in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes taken out of text; other columns stay as they are."""
    names = docs.columns
    place = names.index("text")
    row, spans = free_name(docs, "_row"), free_name(docs, "_spans")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).join(
        repeat_spans(docs).select(F.col("row").alias(row), F.col("spans").alias(spans)), row, "left"
    ).select(*[f"`{n}`" for n in names], spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column(place), batch.column(batch.num_columns - 1)
            new = []
            for i in range(batch.num_rows):
                cuts = united(spans[i].as_py())
                new.append(kept_bytes(text[i].as_buffer().to_pybytes(), cuts).decode("utf-8", "ignore") if cuts else text[i].as_py())
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(new, type=text.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return keyed.mapInArrow(run, docs.schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, packed, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, cuts = repeats.unpack(packed.as_py()), united(spans.as_py())
                left = kept_bytes(text, cuts)
                rows.append((doc_id, len(text), len(text) - len(left), len(cuts), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, type=pa.int64()) for c in columns[:4]), pa.array(columns[4], type=pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    docs = table(spark, sf_dir, "documents")
    return repeats.gather(docs, repeat_spans(docs)).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
