"""Substring dedup on words: recurring passages located by sharded Aho-Corasick automata.

A window is ``LENGTH`` consecutive words of one document. Every word that lies in a window whose words also start in
a document with a smaller doc_id is removed. ``repeats`` finds anchor phrases that recur and gives one representative
for each class of equal contexts. The contexts are dealt to shards by phrase; each shard compiles its confirmed phrases
(exact words, found in two documents at least) into an automaton, streams its contexts through it to locate every
occurrence, and compares the windows around the occurrences. Phrases with very many contexts
(``repeats.HOT_GRAM``) are compared by a digest of each window through a shuffle instead.

Null texts have no words. Documents of fewer than LENGTH words stay whole. Rows that repeat a doc_id don't remove
each other; a null doc_id counts as larger than all others. Columns beside doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import table
from .suffix_dedup import united
from .textblocks import gram_hashes, prefix_hash, span_hash, text_chunks, word_hashes, words

LENGTH = 50
GRAM = 20
#: Contexts that one automaton serves.
SHARD_CONTEXTS = 4_000


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, begins = words(data, offsets)
    return word_hashes(data, starts, ends), begins


def split(text: bytes) -> list[bytes]:
    """Words: bytes.split() also cuts at the six bytes that separate words, and at no others."""
    return text.split()


def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    own = split(text)
    return [b" ".join(own[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]


def shard_windows(
    pieces: list[bytes], at: np.ndarray, doc: np.ndarray, many: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, window's first word, own): windows around confirmed phrases that a smaller doc of this shard holds too, or
    (own) that only larger docs than the piece's hold besides, where ``many`` docs hold the piece."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    starts, ends, begins = words(data, offsets)
    hashes = prefix_hash(word_hashes(data, starts, ends))
    first = begins[:-1] + at
    phrase_of = [data[a:b].tobytes().decode("latin-1") for a, b in zip(starts[first], ends[first + gram - 1])]
    owners: dict[str, set[int]] = defaultdict(set)
    for phrase, d, several in zip(phrase_of, doc.tolist(), many.tolist()):
        if len(owners[phrase]) < 2:
            owners[phrase] |= {d, -1} if several else {d}
    automaton = ahocorasick.Automaton()
    for phrase, docs in owners.items():
        if len(docs) > 1:
            automaton.add_word(f" {phrase} ", len(phrase))
    none = np.zeros(0, dtype=np.int64)
    if not len(automaton):
        return none, none, none
    automaton.make_automaton()
    piece, place = [], []
    for i, text in enumerate(pieces):
        # a match's last character is the blank behind the phrase; one blank was put in front
        for end, size in automaton.iter(f" {text.decode('latin-1')} "):
            piece.append(i)
            place.append(end - 1 - size + offsets[i])
    piece = np.array(piece, dtype=np.int64)
    where = np.searchsorted(starts, np.array(place, dtype=np.int64))  # the phrase's first word
    low = np.maximum(where - (length - gram), begins[piece])
    high = np.minimum(where, begins[piece + 1] - length)
    count = np.maximum(high - low + 1, 0)
    window = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    window = np.unique(window)
    piece = np.searchsorted(begins, window, side="right") - 1
    digest = span_hash(hashes, window, window + length)
    order = np.argsort(digest, kind="stable")
    window, piece, digest = window[order], piece[order], digest[order]
    new, size = repeats._groups(digest)
    if not len(new):
        return none, none, none
    smallest = np.repeat(np.minimum.reduceat(doc[piece], new), size)
    own = doc[piece] == smallest
    hit = ~own | many[piece]
    return piece[hit], window[hit] - begins[piece[hit]], own[hit]


def compare(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        all_ = pa.Table.from_batches(got)
        all_ = all_.take(pa.array(np.argsort(all_.column("gram").to_numpy(), kind="stable")))
        for part in repeats.whole_grams(all_, SHARD_CONTEXTS):
            gram, context, doc, lo, at, many = (part.column(n).to_numpy() for n in ("gram", "context", "doc", "lo", "at", "many"))
            piece, start, own = shard_windows(part.column("piece").to_pylist(), (at - lo).astype(np.int64), doc, many)
            if len(piece):
                yield repeats.found_spans(gram, context, doc, piece, start, own, LENGTH)

    return pieces.select("gram", "context", "doc", "lo", "at", "many", "piece").repartition("gram").mapInArrow(run, repeats.FOUND_SCHEMA)


def compare_hot(pieces: DataFrame) -> DataFrame:
    """The same for phrases with very many contexts: each window's hash meets its like through a shuffle."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(4).cast(pa.large_binary()).cast(pa.large_string())):
                starts, ends, begins = words(data, offsets)
                digest, bounds = gram_hashes(word_hashes(data, starts, ends), begins, LENGTH)
                gram, context, doc, many = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False)[first:end], np.diff(bounds)) for i in range(4))
                lo = np.arange(len(doc)) - np.repeat(bounds[:-1], np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(digest.view(np.int64)), pa.array(context), pa.array(doc), pa.array(many), pa.array(lo.astype(np.int32))],
                    names=["gram", "digest", "context", "doc", "many", "lo"],
                )

    each = pieces.select("gram", "context", "doc", "many", "piece").mapInArrow(windows, "gram long, digest long, context long, doc long, many boolean, lo int")
    owners = each.groupBy("gram", "digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.max("many").alias("several")).where("least < most or several")
    hit = each.join(owners, ["gram", "digest"]).where("doc > least or many")
    return hit.select("gram", "context", "doc", (F.col("doc") == F.col("least")).alias("own"), "lo", (F.col("lo") + LENGTH).alias("hi")).distinct()


def phrase_spans(docs: DataFrame) -> DataFrame:
    return repeats.find_spans(docs, units, LENGTH, GRAM, True, cut, compare, compare_hot)


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, packed, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own, cuts = split(repeats.unpack(packed.as_py())), united(spans.as_py())
                edges = [0, *(e for s in cuts for e in s), len(own)]
                left = [w for a, b in zip(edges[::2], edges[1::2]) for w in own[a:b]] if cuts else own
                rows.append((doc_id, len(own), len(own) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, type=pa.int64()) for c in columns[:3]), pa.array(columns[3], type=pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    docs = table(spark, sf_dir, "documents")
    return repeats.gather(docs, phrase_spans(docs)).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
