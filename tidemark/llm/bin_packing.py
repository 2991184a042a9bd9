"""Best-fit packing of token pieces into sequences by minimum bin slack.

Texts are tokenised and cut into pieces of at most ``capacity`` tokens. Only the histogram of piece lengths, at most
``capacity`` rows, decides how bins are filled: each bin takes the longest length that is left, and a subset-sum dynamic
program over the lengths still available (a bitset of reachable sums, multiplicities by doubling) finds the fullest
feasible combination for the rest, which is then removed. The same combination is taken as often as its lengths last,
since it stays a fullest one while they do. So there are at most about ``capacity * log2(capacity)`` different bins
however many pieces there are, and the plan, not the pieces, is what the driver works out and hands to the tasks.

Pieces are numbered within their length where they are cut; running sums over (length, task) make these numbers global,
and a piece's number tells its bin and its place there. No group of pieces meets in one task, however common a length is.

Null texts are empty: a document without text is one piece with the end token. Repeated rows and null doc_ids are
documents of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

CAPACITY = 2048
END_TOKEN = 0
#: A blank between two signs that are no space: a byte-level token may begin there and never reaches over it.
CUT = re.compile(r" (?=\S)(?<=\S )")
#: Fixed: the pattern by which the tokenizer's byte-level scheme parts a text, and what it calls a part.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words of smaller signs are parted here; others, whose classes may be younger than a library, by the tokenizer.
LATIN = "\u0250"
#: Words whose ids a Python worker remembers, and the longest of them.
REMEMBERED, LONGEST = 800_000, 40
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def byte_signs() -> dict[int, str]:
    """The sign for each byte of the byte-level scheme: printable ones stand for themselves, the others follow at 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    A text is cut at blanks over which no token reaches, so a word behind such a blank has the same ids everywhere, and
    these are remembered. New words are parted by the scheme's pattern and encoded by the tokenizer's model.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, part: str) -> bytes:
        """The ids of one part of the pattern."""
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.signs))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def word(self, word: str) -> bytes:
        """The ids of a word behind a blank."""
        if word in self.before:
            return self.before[word]
        if word.isalpha() and max(word) < LATIN:
            return self.part(" " + word)
        if max(word) >= LATIN or any(a in word for a in self.added):
            return self.whole(" " + word)
        out = []
        for part in PARTS.findall(" " + word):
            ids = self.known.get(part[1:]) if part[0] == " " else self.parts.get(part)
            if ids is None:
                ids = self.part(part)
                if part[0] != " " and len(part) < 8:
                    self.parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def text(self, text: str) -> bytes:
        first, *words = text.split(" ")
        known = self.known
        new = set(words).difference(known)
        if any(not w or w[0].isspace() or w[-1].isspace() for w in new):
            first, *words = CUT.split(text)
            new = set(words).difference(known)
        for w in new:
            known[w] = self.word(w)
        out = b"".join([self.whole(first), *map(known.__getitem__, words)])
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        if len(known) > REMEMBERED // 2:
            self.known, self.before, self.parts = {}, known, {}
        return out


#: This worker's encoders: tasks that follow each other share what is remembered.
ENCODERS: dict[str, Encoder] = {}


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all but the first have ``capacity``."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, definition: str, capacity: int = CAPACITY, end: int = END_TOKEN) -> DataFrame:
    """One row per piece, with the task that cut it and its number among that task's pieces of its length.

    ``definition`` is the tokenizer's file as text: tasks need no file of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value not in ENCODERS:
            ENCODERS.clear()
            ENCODERS[shared.value] = Encoder(shared.value)
        encoder, part, seen = ENCODERS[shared.value], TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encoder.text(text.as_py() or "") + tail)
                for i, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((doc, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=PIECE_SCHEMA.replace(",", "").split()[::2])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> Counter:
    """The combination of lengths, none taken more often than it counts, with the largest sum up to ``room``.

    ``lengths`` descend; sums are bits of a number, and the program ends as soon as ``room`` is reached exactly.
    """
    reach, all_, goal, steps = 1, (1 << room + 1) - 1, 1 << room, []
    for length in lengths:
        left, times = min(counts[length], room // length), 1
        while left > 0 and not reach & goal:
            take = min(times, left)
            grown = (reach | reach << take * length) & all_
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, times = left - take, times * 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += take
            total -= take * length
    return chosen


def fill_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """Bins for all lengths of a histogram: (how many such bins, length -> how many of it)."""
    left, bins = {n: c for n, c in histogram.items() if c}, []
    order = sorted(left, reverse=True)
    while order:
        longest = order[0]
        left[longest] -= 1
        room = capacity - longest
        chosen = fullest(room, [n for n in order if n <= room], left)
        left[longest] += 1
        chosen[longest] += 1
        times = min(left[n] // k for n, k in chosen.items())
        bins.append((times, chosen))
        for n, k in chosen.items():
            left[n] -= times * k
        order = [n for n in order if left[n]]
    return bins


def slots(bins: list[tuple[int, Counter]]) -> tuple[np.ndarray, ...]:
    """Where the numbered pieces of each length go, sorted by length and first number: length << 48 | first number, first
    number, pieces a bin, first bin, place of the first such piece in a bin."""
    rows, used, base = [], Counter(), 0
    for times, chosen in bins:
        at = 0
        for length, k in sorted(chosen.items(), reverse=True):
            rows.append((length << 48 | used[length], used[length], k, base, at))
            used[length] += times * k
            at += k * length
        base += times
    return tuple(np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T)


def pack(numbered: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with length (1 to ``capacity``), part and nth, a row's number among those of its
    length and part, from 0. ``numbered`` is read twice, so it should be a table that is written."""
    if not 0 < capacity < 1 << 15:
        raise ValueError("capacity must be between 1 and 32767")
    counts = numbered.groupBy("length", "part").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["_n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths from {min(histogram)} to {max(histogram)} with a capacity of {capacity}")
    where = numbered.sparkSession.sparkContext.broadcast(slots(fill_bins(histogram, capacity)))
    # one row for each task and length: running sums over tasks
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = numbered.join(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("_before")), ["length", "part"])
    out = ranked.select(*[c for c in numbered.columns if c not in ("part", "nth")], (F.col("_before") + F.col("nth")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, each, base, place = where.value
        for batch in batches:
            rank, length = batch.column("_rank").to_numpy(), batch.column("length").to_numpy()
            slot = np.searchsorted(key, length << 48 | rank, side="right") - 1
            bin_, nth = np.divmod(rank - first[slot], each[slot])
            own = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(base[slot] + bin_), pa.array(place[slot] + nth * length)], names=[*own.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{n}` {t}" for n, t in out.drop("_rank").dtypes)
    return out.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. ``path``: the tokenizer's file."""
    with open(path or tokenizer_file(), encoding="utf-8") as f:
        definition = f.read()
    return pack(keep(pieces(docs, definition, capacity)), capacity)


def op12_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
