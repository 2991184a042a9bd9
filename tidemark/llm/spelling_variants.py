"""Spelling variants of words, grouped by one-edit neighbours of a much larger count.

Two words are near if one insertion, deletion or replacement of a code point makes them equal. Near words share all but
``q`` of their grams of ``q`` code points, at the same place or, behind the edit, one place off. An inverted index over
(gram, place, length) finds them:

1. A word is posted under its rarest grams, as many as no single edit destroys together, so near words meet under one of
   them. It is indexed under its own length, and probes its own length and the next one, at both places.
2. The words posted under one key form a block. A task indexes a block's words by all their positional grams; a probe
   heap-merges the postings of its grams, except the longest ones, which are only searched for what the others gave, and
   keeps the words that reach ``length - 2 q + 1`` common grams, what one edit leaves at least. These are verified.
3. A block over ``PART`` words is dealt in parts by a hash, each of which meets all of the block's probes, so no key gathers
   in one task and no pair is lost.

The order of grams comes from counts over all words in a fixed number of hash buckets, so it is bounded for any alphabet.

Null texts have no words. Null doc_ids are written as nothing. Repeated rows count again. An empty table gives no row.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keep, table

GRAM = 3
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One occurrence in so many loses a code point.
SLIPS = 31
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as its variant.
TIMES = 10
#: Words of a block that are indexed in one task.
PART = 16_384
#: Hash buckets of grams.
BUCKETS = 1 << 20
BATCH_ROWS = 8192

POSTED_SCHEMA = "gram int, at int, size int, own boolean, word string"


def counted_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters of all texts in ASCII lower case, after the slips that the hash of document and run decides."""
    long = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0)), lambda w: F.char_length(w) >= least_letters)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(long).alias("w"))
    low = runs.select("d", F.translate("w", UPPER, LOWER).alias("w"))
    h = low.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("w")).cast("int")
    word = F.when(F.col("h") % SLIPS == 0, F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))).otherwise(F.col("w"))
    return h.select(word.alias("word")).where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def gram_order(words: DataFrame, q: int = GRAM) -> np.ndarray:
    """The rank of each bucket of grams, the rarest first: as many numbers as there are buckets, whatever the words."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - q + 1), lambda i: F.substring(F.col("word"), i, F.lit(q)))).alias("g"))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    # at most BUCKETS rows
    for bucket, n in grams.groupBy((F.crc32(F.col("g").cast("binary")) % BUCKETS).cast("int").alias("b")).count().collect():
        counts[bucket] = n
    order = np.empty(BUCKETS, dtype=np.int32)
    order[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.int32)
    return order


def leading_grams(word: str, order: np.ndarray, q: int) -> list[tuple[int, int]]:
    """(rank, place) of a word's rarest grams: the fewest that one edit can't destroy together, which is where two of them
    are ``q`` or more apart. A gram of the last one's kind right behind it belongs to them as well, since an edit may have
    moved the last one there."""
    ranked = sorted((int(order[zlib.crc32(word[i : i + q].encode()) % BUCKETS]), i) for i in range(len(word) - q + 1))
    low = high = ranked[0][1]
    for n, (_, i) in enumerate(ranked, 1):
        low, high = min(low, i), max(high, i)
        if high - low >= q:
            break
    else:
        raise ValueError(f"{word!r} has fewer than {2 * q} code points")
    rank, at = ranked[n - 1]
    return ranked[:n] + [x for x in ranked[n : n + 1] if x == (rank, at + 1)]


def posted(words: DataFrame, q: int = GRAM) -> DataFrame:
    """The rows under which each word is indexed (own) or probes the index of the next length."""
    order = words.sparkSession.sparkContext.broadcast(gram_order(words, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, at, size, own, which = [], [], [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                rows = set()
                for g, p in leading_grams(word, order.value, q):
                    rows |= {(g, p, len(word), True), (g, p, len(word) + 1, False), (g, p + 1, len(word) + 1, False)}
                for g, p, n, o in rows:
                    gram.append(g), at.append(p), size.append(n), own.append(o), which.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram, pa.int32()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(own, pa.bool_()), batch.column(0).take(pa.array(which, pa.int64()))],
                names=["gram", "at", "size", "own", "word"],
            )

    return words.select("word").mapInArrow(run, POSTED_SCHEMA)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes two words equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = 0
    while same < len(a) and a[same] == b[same]:
        same += 1
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def merged(lists: list[list[int]], need: int) -> list[int]:
    """The numbers that stand in at least ``need`` of the sorted lists, a heap merging all but the ``need - 1`` longest."""
    if len(lists) < need:
        return []
    lists.sort(key=len)
    short, long = lists[: len(lists) - need + 1], lists[: len(lists) - need : -1]
    found, last, count, most = [], -1, 0, len(long)
    stream = heapq.merge(*short) if len(short) > 1 else iter(short[0])
    for x in itertools.chain(stream, (-1,)):
        if x == last:
            count += 1
            continue
        if count >= need:
            found.append(last)
        elif count:
            left = most
            for other in long:  # from the longest on
                i = bisect_left(other, last)
                if i < len(other) and other[i] == last:
                    count += 1
                    if count == need:
                        found.append(last)
                        break
                left -= 1
                if count + left < need:
                    break
        last, count = x, 1
    return found


class Block:
    """Words of one length under one key, indexed by all their positional grams once something probes them.

    The key's gram stands at ``at`` in all of them. One edit lies on one side of it, so near words agree on the other side:
    a look at that comes before they are compared letter by letter.
    """

    def __init__(self, at: int, size: int, q: int) -> None:
        self.at, self.end, self.q, self.places, self.need = at, at + q, q, size - q + 1, size - 2 * q + 1
        self.words: list[str] = []
        self.index: list[dict[str, list[int]]] = []

    def _build(self) -> None:
        self.index = [{} for _ in range(self.places)]
        for i, w in enumerate(self.words):
            for p, at in enumerate(self.index):
                at.setdefault(w[p : p + self.q], []).append(i)

    def probe(self, word: str, own: bool) -> list[tuple[str, str]]:
        """The near pairs of a word of the same length (``own``, then only with greater words) or of one code point less."""
        if not self.index:
            self._build()
        lists = []
        for p in range(len(word) - self.q + 1):
            g = word[p : p + self.q]
            if got := self.index[p].get(g):
                lists.append(got)
            if not own and (got := self.index[p + 1].get(g)):
                lists.append(got)
        # a word of one code point less has the gram at the same place before the edit, one place earlier behind it
        head, tail = (word[: self.at], word[self.end :]) if own else (word[: self.end], word[max(self.at - 1, 0) :])
        ends = self.at if own else self.end
        begins = self.end if own else self.at
        near = (self.words[i] for i in merged(lists, self.need))
        return [(word, w) for w in near if (w[:ends] == head or w[begins:] == tail) and (not own or word < w) and one_edit(word, w)]

    def among(self) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        if len(self.words) < 2:
            return out
        self._build()
        for i, w in enumerate(self.words):
            # of each list the words behind this one
            lists = []
            for p, at in enumerate(self.index):
                got = at[w[p : p + self.q]]
                if got[-1] > i:
                    lists.append(got[bisect_right(got, i) :] if got[0] <= i else got)
            if len(lists) < self.need:
                continue
            head, tail = w[: self.at], w[self.end :]
            for j in merged(lists, self.need):
                other = self.words[j]
                if (other[: self.at] == head or other[self.end :] == tail) and one_edit(w, other):
                    out.append((w, other) if w < other else (other, w))
        return out


def near_pairs(words: DataFrame, q: int = GRAM, part: int = PART) -> DataFrame:
    """a, b: every pair of near words once, for distinct words (column ``word``) of at least ``2 q`` code points."""
    rows = keep(posted(words, q))
    key = ["gram", "at", "size"]
    heavy = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > part).select(*key, F.ceil(F.col("_n") / part).cast("int").alias("_parts"))
    dealt = rows.join(heavy, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # a part's own words come first, then what probes them
    ordered = dealt.select(*key, "part", (F.col("own") & (mine == F.col("part"))).alias("here"), "own", "word").repartition(*key, "part").sortWithinPartitions(*key, "part", F.col("here").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block, closed, out = None, Block(0, 0, q), True, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)])
            here, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 5))
            first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if batch.num_rows else np.zeros(0, dtype=np.int64)
            last = np.append(first[1:], batch.num_rows)
            # a block of one row, or one that indexes nothing, has no pair; the batch's first and last may go on elsewhere
            live = here[first] & (last - first > 1)
            live[:1] = live[-1:] = True
            words = batch.column(6)
            for lo, hi in zip(first[live].tolist(), last[live].tolist()):
                if (new := tuple(keys[:, lo])) != name:
                    if not closed:
                        out += block.among()
                    name, block, closed = new, Block(int(new[1]), int(new[2]), q), False
                for i, word in enumerate(words.slice(lo, hi - lo).to_pylist(), lo):
                    if here[i]:
                        block.words.append(word)
                        continue
                    if not closed:
                        out += block.among()
                        closed = True
                    if block.words:
                        out += block.probe(word, own[i])
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["a", "b"])
                out = []
        if not closed:
            out += block.among()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["a", "b"])

    return ordered.mapInArrow(run, "a string, b string").distinct()


def variants(words: DataFrame, times: int = TIMES, q: int = GRAM, part: int = PART) -> DataFrame:
    """word, form, root, n, n_near, form_n for counted words (distinct ``word``, ``n``).

    A word's form is its near word of the largest count, the smallest in code-point order among equals, if it counts at
    least ``times`` as much; its root is where the forms lead. Counts grow along that way by ``times``, so its length
    and the number of rounds that follow it are bounded by a logarithm of the largest count.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent as its variant")
    words = keep(words.select("word", "n"))
    pairs = near_pairs(words, q, part)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("m"), F.col("b").alias("b"), "m")).alias("best"))
    good = F.col("best.m") >= times * F.col("n")
    found = keep(words.join(best.withColumnRenamed("a", "word"), "word", "left").select(
        "word", F.when(good, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.m")).alias("form_n")
    ))
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(int(math.log(most, times)), 1)
    roots = keep(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):  # each round doubles the steps behind a root
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        before, roots = roots, keep(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
        discard(before)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = f"""
WITH bits AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(w, '{UPPER}', '{LOWER}') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= {LEAST_LETTERS}
), runs_once AS (
  SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS x FROM runs GROUP BY d, w
), hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs_once, bits
), slipped AS (
  SELECT CASE WHEN h % {SLIPS} = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), cut AS (
  SELECT word, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS form, max(w.n) AS form_n FROM near JOIN words w ON w.word = other GROUP BY near.word
), formed AS (
  SELECT w.word, CASE WHEN form_n >= {TIMES} * w.n THEN form END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), roots AS (
  SELECT f.word, coalesce(e.form, d.form, c.form, b.form, f.form, f.word) AS root
  FROM formed f LEFT JOIN formed b ON b.word = f.form LEFT JOIN formed c ON c.word = b.form LEFT JOIN formed d ON d.word = c.form LEFT JOIN formed e ON e.word = d.form
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted_words(table(spark, sf_dir, "documents")))
