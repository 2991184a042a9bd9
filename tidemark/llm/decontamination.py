"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every passage of every training document (windows of ``PASSAGE`` tokens, half a window apart) queries the index.
The entries of the index are segments of test items; an entry's impacts are divided by the score that it gives
itself, so one threshold means the same share for all entries. Entries are put in order of that score and cut into
``GROUPS`` groups. Passages whose tokens' largest impacts in a group add up to less than the threshold pass it over,
which sums over whole batches decide; in the other groups they search with WAND over blocks of postings and retrieve
every entry above the threshold. A retrieved item counts as leaked if at least ``OVERLAP`` of the five-token runs of
its question and of its answer (its last quarter) occur in the document.

Tokens are runs of ASCII letters, digits and bytes above 127, with A-Z and Latin-1 letters lower-cased. Null and empty texts leak
nothing, nor do items without tokens. Repeated rows are judged one by one. Columns beside doc_id and text are passed
through by ``drop_leaks`` and left out by ``find_leaks``. Items are read into indexes of at most ``INDEX_BYTES`` of
text; more items are searched index by index.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textblocks import byte_codes, fold, prefix_hash, span_hash, text_chunks

PASSAGE = 64
THRESHOLD = 0.6
OVERLAP = 0.8
RUN = 5
K1, B = 1.2, 0.75
BLOCK = 4
GROUPS = 16
#: Bytes of item text in one index that is sent to the executors.
INDEX_BYTES = 32 << 20

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and where each text's tokens begin (one entry more than texts)."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = _TOKEN[data]
    starts, ends = solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]
    inner = offsets[1:-1]
    cut = inner[solid[inner] & solid[inner + 1]]
    starts[cut] = ends[cut] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return span_hash(prefix_hash(byte_codes(fold(data))), starts, ends), np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, n: int = RUN) -> np.ndarray:
    """Hashes of all runs of n tokens."""
    at = np.arange(max(len(hashes) - n + 1, 0))
    return span_hash(prefix_hash(hashes), at, at + n)


class Postings:
    """Posting lists by (term, group) in a few arrays: entries, shares and the largest share of each block."""

    def __init__(self, key: np.ndarray, groups: int, spot: np.ndarray, share: np.ndarray):
        self.groups, self.spot, self.share = groups, spot.astype(np.int32), share
        start = np.flatnonzero(np.diff(key, prepend=-1))
        self.keys, self.starts = key[start], np.append(start, len(key))
        inside = np.arange(len(key)) - np.repeat(start, np.diff(self.starts))
        block = np.flatnonzero(inside % BLOCK == 0)
        self.tops = np.maximum.reduceat(share, block) if len(block) else share
        self.top_starts = np.searchsorted(block, self.starts)

    def get(self, wanted: tuple[int, int], default=None):
        key = wanted[0] * self.groups + wanted[1]
        i = int(np.searchsorted(self.keys, key))
        if i == len(self.keys) or self.keys[i] != key:
            return default
        a, b = self.starts[i], self.starts[i + 1]
        return self.spot[a:b].tolist(), self.share[a:b].tolist(), self.tops[self.top_starts[i] : self.top_starts[i + 1]].tolist()


class ItemIndex:
    """An inverted index of test items, with impacts by block, and what is needed to confirm an item."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = pa.array([t or "" for _, t in items], type=pa.large_string())
        self.ids: list[int] = []
        self.checks: list[tuple[int, np.ndarray, np.ndarray]] = []
        entries: list[tuple[int, np.ndarray]] = []
        for first, end, data, offsets in text_chunks(texts):
            hashes, begins = tokens(data, offsets)
            for i in range(end - first):
                own = hashes[begins[i] : begins[i + 1]]
                if not len(own):
                    continue
                n = min(RUN, len(own))
                split = len(own) - max(1, round(len(own) / 4))
                grams = runs(own, n)
                answers = np.arange(len(grams)) + n > split
                entries += [(len(self.ids), own[k : k + PASSAGE]) for k in range(0, max(len(own) - PASSAGE // 2, 1), PASSAGE)]
                self.ids.append(items[first + i][0])
                self.checks.append((n, np.unique(grams[~answers]), np.unique(grams[answers])))
        self._post(entries)

    def _post(self, entries: list[tuple[int, np.ndarray]]) -> None:
        sizes = np.array([len(own) for _, own in entries], dtype=np.int64)
        terms = np.concatenate([own for _, own in entries]) if entries else np.zeros(0, dtype=np.uint64)
        self.vocabulary, term = np.unique(terms, return_inverse=True)
        n_terms, n = max(len(self.vocabulary), 1), len(entries)
        # one row per entry and term that it holds, with how often
        pairs, tf = np.unique(np.repeat(np.arange(n), sizes) * n_terms + term, return_counts=True)
        at, term = np.divmod(pairs, n_terms)
        holders = np.bincount(term, minlength=n_terms)[term]
        mean = sizes.mean() if n else 1.0
        impact = np.log(1 + (n - holders + 0.5) / (holders + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[at] / mean))
        whole = np.bincount(at, weights=impact, minlength=n)
        order = np.argsort(whole, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        self.owner = [entries[e][0] for e in order]
        self.group_ends = [int(x[-1]) + 1 for x in np.array_split(np.arange(n), GROUPS) if len(x)]
        spot, share = place[at], impact / whole[at] if n else impact
        by = np.lexsort((spot, term))
        spot, share, term = spot[by], share[by], term[by]
        group = np.searchsorted(self.group_ends, spot, side="right")
        self.postings = Postings(term * max(len(self.group_ends), 1) + group, max(len(self.group_ends), 1), spot, share)
        self.most = np.zeros((len(self.vocabulary), len(self.group_ends)), dtype=np.float32)
        np.maximum.at(self.most, (term, group), share.astype(np.float32))

    def search(self, terms: np.ndarray, group: int, threshold: float) -> list[tuple[int, float]]:
        """All entries of a group whose score for these terms reaches the threshold, by block-max WAND."""
        end = len(self.owner)
        lists = [[0, *found, max(found[2])] for t in terms.tolist() if (found := self.postings.get((t, group)))]
        here = lambda x: x[1][x[0]] if x[0] < len(x[1]) else end
        found = []
        while True:
            lists.sort(key=here)
            total, pivot = 0.0, None
            for x in lists:
                total += x[4]
                if total >= threshold - 1e-6:
                    pivot = here(x)
                    break
            if pivot is None or pivot == end:
                return found
            near = [x for x in lists if here(x) <= pivot]
            for x in near:
                while x[0] < len(x[1]) and x[1][x[0]] < pivot:
                    skip = (x[0] // BLOCK + 1) * BLOCK
                    x[0] = skip if skip < len(x[1]) and x[1][skip] <= pivot else x[0] + 1
            at = [x for x in near if here(x) == pivot]
            # the blocks that hold the pivot bound its score more tightly than whole lists
            if sum(x[3][x[0] // BLOCK] for x in at) >= threshold - 1e-6:
                score = sum(x[2][x[0]] for x in at)
                if score >= threshold - 1e-6:
                    found.append((pivot, score))
            for x in at:
                x[0] += 1

    def leaks(self, column: pa.Array, threshold: float, overlap: float) -> Iterator[tuple[int, int, int, float, float, float]]:
        """Yields (row, item_id, passages, score, question overlap, answer overlap) of every confirmed leak."""
        if not len(self.vocabulary):
            return
        half = PASSAGE // 2
        for first, _, data, offsets in text_chunks(column):
            hashes, begins = tokens(data, offsets)
            at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
            known = np.flatnonzero(self.vocabulary[at] == hashes)
            # passages are pairs of neighbouring halves; each half's bound takes a term once
            halves = np.maximum(-(-np.diff(begins) // half), 1)
            first_half = np.concatenate([[0], np.cumsum(halves)])
            text = np.searchsorted(begins, known, side="right") - 1
            own_half = first_half[text] + (known - begins[text]) // half
            pairs = np.unique(own_half * len(self.vocabulary) + at[known])
            owner, term = np.divmod(pairs, len(self.vocabulary))
            bound = np.zeros((first_half[-1] + 1, self.most.shape[1]), dtype=np.float32)
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(edges):
                bound[owner[edges]] = np.add.reduceat(self.most[term], edges, axis=0)
            bound[:-1] += bound[1:]
            hits: dict[int, dict[int, tuple[int, float]]] = defaultdict(dict)
            starts = np.searchsorted(owner, np.arange(first_half[-1] + 2))
            text_of = np.repeat(np.arange(len(halves)), halves)
            for p, group in zip(*np.nonzero(bound[:-1] >= threshold - 1e-6)):
                t = text_of[p]
                last = p + 1 < len(text_of) and text_of[p + 1] == t
                terms = np.unique(term[starts[p] : starts[p + 1 + last]])
                if self.most[terms, group].sum() < threshold - 1e-6:
                    continue
                own = hits[int(t)]
                for entry, score in self.search(terms, group, threshold):
                    n, best = own.get(self.owner[entry], (0, 0.0))
                    own[self.owner[entry]] = (n + 1, max(best, score))
            for t, own in hits.items():
                grams: dict[int, np.ndarray] = {}
                for item, (n, score) in sorted(own.items()):
                    size, question, answer = self.checks[item]
                    if size not in grams:
                        grams[size] = np.unique(runs(hashes[begins[t] : begins[t + 1]], size))
                    q = float(np.isin(question, grams[size]).mean()) if len(question) else 1.0
                    a = float(np.isin(answer, grams[size]).mean())
                    if q >= overlap and a >= overlap:
                        yield first + t, self.ids[item], n, round(score, 6), round(q, 6), round(a, 6)


def item_indexes(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The test items in groups of at most INDEX_BYTES of text, read group by group."""
    group, size = [], 0
    for item_id, text in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        group.append((item_id, text))
        size += len(text or "") * 4
        if size > INDEX_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, passages, score, question_overlap, answer_overlap."""
    schema = "doc_id long, item_id long, passages long, score double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession

    def searched(index: ItemIndex):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(sent.value.leaks(batch.column(1), threshold, overlap))
                columns = list(zip(*rows)) if rows else [[]] * 6
                ids = batch.column(0).take(pa.array(columns[0], type=pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, type=t) for c, t in zip(columns[1:], [pa.int64()] * 2 + [pa.float64()] * 3)]],
                    names=["doc_id", "item_id", "passages", "score", "question_overlap", "answer_overlap"],
                )

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

    out = None
    for group in item_indexes(items):
        found = searched(ItemIndex(group))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no item has leaked, with all their columns. Nothing is shuffled."""
    spark = docs.sparkSession
    place = docs.columns.index("text")
    for group in item_indexes(items):
        sent = spark.sparkContext.broadcast(ItemIndex(group))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, dtype=bool)
                good[[row for row, *_ in sent.value.leaks(batch.column(place), threshold, overlap)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
