"""Toxicity: noisy-channel restoring of disguised words, then a score of the restored text.

1. ``letter_model``: a trigram model of letters, counted over all texts.
2. ``restore``: words with letters swapped for digits or signs, stretched by repetition or broken up by spacing
   become lattices; Viterbi decoding picks the reading that the letter model and the costs of the disguises favour.
3. ``toxic_features``: words and word beginnings of the restored training texts, with the lower bound of the share of
   toxic texts among those that have them. Toxic texts that share the smallest hash of their word triples count once,
   so a group of copies can't make all of its words toxic.
4. A text's score is the chance that at least one of its three most telling words is right.

Only rows for which ``crc32(doc_id) % 3 != 1`` teach labels, of each label at most about ``MOST_TAUGHT``, picked by the
hash of their doc_id where there are more; letters are counted and texts scored over all rows. Null texts are empty; empty texts and texts without a
known feature score just above 0. Repeated rows are scored one by one. If no training row is labelled toxic, all
texts score 0. Other columns than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, keep, most_frequent, table
from .textblocks import LOWER, byte_codes, fold, mix, prefix_hash, span_hash, text_chunks

#: Letters that digits and signs may stand for. Fixed values.
DISGUISES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}
SEPARATORS = " .-_*"
#: Costs, in nats, of reading a sign as a letter, of leaving it a sign, of a stretched letter, and of a gap in a word.
COST_LETTER, COST_SIGN, COST_STRETCH, COST_GAP = 1.0, 4.0, 0.5, 0.1
#: Bytes of word beginnings that count as features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Lower bounds are taken this many standard deviations down; features below LEAST_SHARE tell nothing.
DEVIATIONS = 2.0
LEAST_SHARE = 0.5
#: Beginnings that fewer words share tell nothing that the words don't.
LEAST_WORDS = 4
#: Labelled rows of each label that teach; with more, a hash of doc_id picks about so many. They are broadcast.
MOST_TAUGHT = 200_000
#: Features that executors are sent, those of the most toxic texts.
MOST_FEATURES = 200_000
#: Runs of one letter longer than this are read whole.
LONG_RUN = 8
#: A text is called toxic from this score.
TOXIC_FROM = 0.7

_A = 64
_CLASS = np.zeros(256, dtype=np.int64)  # 0: not a letter
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128, 256) & 31)
_LETTER = _CLASS > 0
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in DISGUISES]] = True
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True


def letter_model(docs: DataFrame) -> np.ndarray:
    """Costs, in nats, of letter c after a and b, as an array [a, b, c]; at most 64**3 counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_A**3, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                # a blank between texts keeps trigrams within them
                c = _CLASS[np.insert(data, offsets[1:-1], 32)]
                if len(c) > 2:
                    counts += np.bincount((c[:-2] * _A + c[1:-1]) * _A + c[2:], minlength=_A**3)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_A**3)
    counts[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    three = counts.reshape(_A, _A, _A)
    two = three.sum(axis=0)
    one = (two.sum(axis=0) + 1) / (two.sum() + _A)
    share2 = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    share3 = (three + 5 * share2[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(share3)


def _arcs(word: str) -> list[list[tuple[int, str, float]]]:
    """For each place of a word, what may be read from there on: (next place, letters, cost)."""
    n = len(word)
    arcs: list[list[tuple[int, str, float]]] = [[] for _ in range(n)]
    end = [n] * n  # of the run of equal letters
    for i in range(n - 2, -1, -1):
        end[i] = end[i + 1] if word[i] == word[i + 1] else i + 1
    i = 0
    while i < n:
        c, run = word[i], end[i]
        here = arcs[i]
        here += [(i + 1, x, COST_LETTER) for x in DISGUISES.get(c, "")]
        if ord(c) > 127 or c.isalpha():
            if run - i > 2:
                here += [(run, c, COST_STRETCH), (run, c + c, COST_STRETCH)]
            if run - i > LONG_RUN:
                # letters read before the rest is taken as stretched only add cost to the stretch from the first one
                here.append((run, c * (run - i), 0.0))
                i = run
                continue
            here.append((i + 1, c, 0.0))
        else:
            here.append((i + 1, c, 0.0 if c not in DISGUISES else COST_SIGN))
            if c in SEPARATORS:
                here.append((i + 1, "", COST_GAP))
        i += 1
    return arcs


def decode(word: str, costs: np.ndarray) -> str:
    """The most likely reading of a disguised word: a Viterbi search over its lattice of letters and gaps."""
    n = len(word)
    arcs = _arcs(word)
    # by place and last two letters: cost, and where the best reading came from
    best: list[dict[tuple[int, int], tuple[float, int, tuple[int, int], str]]] = [{} for _ in range(n + 1)]
    best[0][0, 0] = (0.0, -1, (0, 0), "")
    for i in range(n):
        for state, (cost, *_) in best[i].items():
            for to, out, extra in arcs[i]:
                (x, y), total = state, cost + extra
                for ch in out[:3]:
                    z = int(_CLASS[min(ord(ch), 255)])
                    total += costs[x, y, z]
                    x, y = y, z
                if len(out) > 3:  # a long run: the same step again and again
                    total += (len(out) - 3) * costs[y, y, y]
                old = best[to].get((x, y))
                if old is None or total < old[0]:
                    best[to][x, y] = (total, i, state, out)
    readings = []
    for state, (cost, *_) in best[n].items():
        readings.append((cost + costs[state[0], state[1], 0], state))
    least, parts = min(readings)[1], []
    at = n
    while at:
        _, before, previous, out = best[at][least]
        parts.append(out)
        at, least = before, previous
    return "".join(reversed(parts))


def suspects(data: np.ndarray) -> list[tuple[int, int]]:
    """Spans (first byte, end) of words that may be disguised, in order, apart from each other."""
    n = len(data)
    if n < 4:
        return []
    low, letter = LOWER[data], _LETTER[data]
    sign = _SIGN[data]
    hit = np.zeros(n, dtype=bool)
    hit[:-1] |= sign[:-1] & letter[1:]
    # two signs behind a letter; a call's marks are none
    inner = sign & (data != 33) & (data != 43)
    hit[:-2] |= letter[:-2] & inner[1:-1] & inner[2:]
    hit[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & (data[:-2] < 128)
    single = letter.copy() & (data < 128)
    single |= sign
    alone = single.copy()
    alone[1:] &= ~(letter | sign)[:-1]
    alone[:-1] &= ~(letter | sign)[1:]
    gap = np.zeros(n, dtype=bool)
    gap[1:-1] = _SEPARATOR[data[1:-1]] & alone[:-2] & alone[2:]
    # four letters in a row, with three gaps between
    broken = np.zeros(n, dtype=bool)
    if n >= 7:
        broken[:-6] = alone[:-6] & gap[1:-5] & gap[3:-3] & gap[5:-1]
    spans: list[tuple[int, int]] = []
    part = letter | sign
    for i in np.flatnonzero(hit | broken).tolist():
        if spans and i < spans[-1][1]:
            continue
        a, b = i, i + 1
        if broken[i]:
            while b + 1 < n and gap[b] and alone[b + 1]:
                b += 2
        else:
            while a and part[a - 1] and (not spans or a > spans[-1][1]):
                a -= 1
            while b < n and part[b]:
                b += 1
        spans.append((a, b))
    return spans


class Restorer:
    """Decodes disguised words; keeps what it has decoded."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.known = costs, {}

    def word(self, raw: bytes) -> bytes:
        out = self.known.get(raw)
        if out is None:
            if len(self.known) > 100_000:
                self.known.clear()
            text = raw.decode("utf-8", "replace").lower()
            out = self.known[raw] = decode(text, self.costs).encode()
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunk with disguised words restored."""
        guarded = np.insert(data, offsets[1:-1], 10)  # a line break between texts
        moved = offsets + np.arange(len(offsets))
        spans = suspects(guarded)
        if not spans:
            return data, offsets
        raw = guarded.tobytes()
        parts, at, shift, marks = [], 0, 0, []
        for a, b in spans:
            new = self.word(raw[a:b])
            parts += [raw[at:a], new]
            marks.append((b, shift := shift + len(new) - (b - a)))
            at = b
        parts.append(raw[at:])
        last = np.array([b for b, _ in marks])
        shifts = np.array([0, *[s for _, s in marks]])
        bounds = moved + shifts[np.searchsorted(last, moved, side="right")]
        bounds[-1] = len(raw) + shift + 1
        restored = np.frombuffer(b"".join(parts), dtype=np.uint8)
        # the breaks that were put in stand before each later text's first byte
        keep = np.ones(len(restored), dtype=bool)
        keep[bounds[1:-1] - 1] = False
        return restored[keep], bounds - np.arange(len(bounds))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word number, hash) of all words and word beginnings."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = _LETTER[data]
    starts, ends = solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]
    inner = offsets[1:-1]
    cut = inner[solid[inner] & solid[inner + 1]]
    starts[cut] = ends[cut] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    text = np.searchsorted(offsets, starts, side="right") - 1
    prefix = prefix_hash(byte_codes(fold(data)))
    size = ends - starts
    number = np.arange(len(starts))
    out = [(text, number, span_hash(prefix, starts, ends))]
    for n in BEGINNINGS:
        m = size > n
        out.append((text[m], number[m], span_hash(prefix, starts[m], starts[m] + n) ^ np.uint64(n)))
    return tuple(np.concatenate(x) for x in zip(*out))


def toxic_features(train: DataFrame, costs: np.ndarray) -> pd.DataFrame:
    """h, share: the features that tell toxic texts, from rows (text, toxic). At most MOST_FEATURES are told apart."""
    sent = train.sparkSession.sparkContext.broadcast(costs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(0)):
                text, number, h = features(*restorer.texts(data, offsets))
                n_words = int(number.max()) + 1 if len(number) else 0
                whole, owner = h[:n_words], text[:n_words]  # words come before beginnings
                triples = mix(whole[:-2] * np.uint64(3) + whole[1:-1] * np.uint64(5) + whole[2:])
                same = owner[:-2] == owner[2:]
                # texts of one or two words are groups of their own words
                least = np.full(end - first, np.iinfo(np.uint64).max, dtype=np.uint64)
                np.minimum.at(least, owner[:-2][same], triples[same])
                held = np.bincount(owner, minlength=end - first)
                begin = np.cumsum(held) - held
                one, two = np.flatnonzero(held == 1), np.flatnonzero(held == 2)
                least[one] = mix(whole[begin[one]])
                least[two] = mix(whole[begin[two]] * np.uint64(3) + whole[begin[two] + 1] * np.uint64(5))
                # one bit for each of 32 classes of words that begin so; a whole word has them all
                bits = np.where(np.arange(len(h)) < n_words, np.int64(2**32 - 1), np.int64(1) << (whole[number] % np.uint64(32)).astype(np.int64))
                order = np.lexsort((h, text))
                text, h, bits = text[order], h[order], bits[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                bits = np.bitwise_or.reduceat(bits, np.flatnonzero(new)) if len(h) else bits
                begins = pa.array(np.searchsorted(text[new], np.arange(end - first + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.ListArray.from_arrays(begins, pa.array(h[new].view(np.int64))), pa.ListArray.from_arrays(begins, pa.array(bits))],
                    names=["group", "features", "bits"],
                )

    # one text of each group of near copies teaches what is toxic; all others teach what is not
    described = train.where("toxic = 1").select("text").mapInArrow(describe, "group long, features array<long>, bits array<long>")
    single = described.groupBy("group").agg(F.min_by(F.arrays_zip("features", "bits"), F.xxhash64("features", "bits")).alias("f"))
    each = single.select(F.explode("f").alias("f")).groupBy("f.features").agg(F.count("*").alias("yes"), F.bit_or("f.bits").alias("bits"))
    yes = keep(each.where((F.col("yes") > 2) & (F.bit_count("bits") >= LEAST_WORDS)).select(F.col("features").alias("h"), "yes"))
    found = most_frequent(yes, "yes", MOST_FEATURES).toPandas()
    discard(yes)
    h = found["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    h, yes_count = h[order], found["yes"].to_numpy(dtype=np.float64)[order]
    wanted = train.sparkSession.sparkContext.broadcast(h)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(sent.value), wanted.value
        n = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)) if len(known) else ():
                text, _, h = features(*restorer.texts(data, offsets))
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                # each text counts once
                n += np.bincount(np.unique(text[hit] * len(known) + at[hit]) % len(known), minlength=len(known))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["at", "no"])

    rows = train.where("toxic <> 1").select("text").mapInArrow(count, "at int, no long").groupBy("at").agg(F.sum("no").alias("no")).toPandas()
    no_count = np.zeros(len(h))
    no_count[rows["at"].to_numpy(dtype=np.int64)] = rows["no"].to_numpy(dtype=np.float64)
    n, z = yes_count + no_count, DEVIATIONS
    p = yes_count / np.maximum(n, 1)
    share = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) if len(h) else n
    out = pd.DataFrame({"h": h.view(np.int64), "share": share})
    return out[out["share"] >= LEAST_SHARE / 2].reset_index(drop=True)


def taught_rows(labels: DataFrame, most: int = MOST_TAUGHT) -> DataFrame:
    """doc_id, toxic of the rows that teach: all outside the held-out third, or about ``most`` of each label by hash."""
    rows = labels.where(crc_mod("doc_id", 3) != 1).where("toxic is not null").select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = 1 << 20
    share = F.lit(parts)
    for toxic, n in counts.items():
        if n > most:
            share = F.when(F.col("toxic") == toxic, int(parts * most / n)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)


def score_texts(docs: DataFrame, model: pd.DataFrame, costs: np.ndarray) -> DataFrame:
    """doc_id, score of each row of ``docs``."""
    model = model.assign(h=model["h"].to_numpy(dtype=np.int64).view(np.uint64)).sort_values("h")
    sent = docs.sparkSession.sparkContext.broadcast((costs, model["h"].to_numpy(), model["share"].to_numpy(dtype=np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, known, share = sent.value
        restorer = Restorer(costs)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for first, end, data, offsets in text_chunks(batch.column(1)):
                text, number, h = features(*restorer.texts(data, offsets))
                if not len(known) or not len(h):
                    continue
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                text, number, p = text[hit], number[hit], share[at[hit]]
                # each word by its most telling feature, each text by its three most telling words
                order = np.lexsort((-p, number))
                text, number, p = text[order], number[order], p[order]
                new = np.diff(number, prepend=-1) > 0
                text, p = text[new], p[new]
                order = np.lexsort((-p, text))
                text, p = text[order], p[order]
                begin = np.searchsorted(text, text, side="left")
                rank = np.arange(len(text)) - begin
                weak = np.zeros(end - first)
                np.maximum.at(weak, text, p)
                strong = (rank < 3) & (p >= LEAST_SHARE)
                miss = np.ones(end - first)
                np.multiply.at(miss, text[strong], 1 - p[strong])
                score[first:end] = np.where(miss < 1, 1 - miss, weak)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(score, 6))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``; labels of held-out rows are not read."""
    costs = letter_model(docs)
    # the rows that teach are bounded, so texts stay where they are
    train = docs.select("doc_id", "text").where(crc_mod("doc_id", 3) != 1).join(F.broadcast(taught_rows(labels)), "doc_id")
    model = toxic_features(train, costs)
    return score_texts(docs, model, costs).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
