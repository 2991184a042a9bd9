"""LM scoring: a gated recurrent network in numpy with a class-factored output, and whole-document log-likelihoods.

Tokens are lower-cased words and one end per text. The ``SOFT_WORDS`` most frequent tokens have vectors of their own
and are put, by frequency, into classes of ``CLASS_WORDS``; all other words fall into tail classes by the look of
their letters. The network gives the chance of the next token's class and, in the first kind of class, of the word
within it; in a tail class words have their share of the class's tokens, counted over all training texts and smoothed
by one, with one share for all unknown words. These chances sum to one over known words and the unknown word.

Learning runs over all training texts in ``ROUNDS``, each on its own share of them: every task starts from the
round's weights, walks through its texts in windows of ``WINDOW`` tokens, carries the state from window to window and
propagates back within every window, so that each token of each training text gives gradients once; Spark averages the
tasks' weights. Counts cover all tokens of all training texts. The vocabulary's ``HEAD_WORDS`` most frequent words are
sent to executors, counts of rarer ones are joined.

Null and empty texts consist of their end. Repeated rows are scored one by one. A null doc_id teaches. If nothing
teaches, all words are unknown and all chances even. Other columns than doc_id and text are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, keep, most_frequent, table
from .textblocks import text_chunks, word_hashes, words

SOFT_WORDS = 1024
CLASS_WORDS = 32
TAIL_CLASSES = 32
HEAD_WORDS = 200_000
HIDDEN = 12
WINDOW = 16
UPDATE_TOKENS = 1024
#: Shares of the training texts, in 32nds, that each round learns from.
ROUNDS = (4, 12, 16)
RATE = 0.07
#: What squared gradients start from; it keeps the first steps short.
FIRST_SQUARE = 0.2
#: Tokens that the network walks through side by side.
CHUNK_TOKENS = 1_500_000
#: Texts that learning walks through side by side at most, which bounds what a window holds.
SIDE_BY_SIDE = 8192
#: The weights that one row carries while tasks' weights are averaged.
BLOCK = 4096

SOFT_CLASSES = SOFT_WORDS // CLASS_WORDS
CLASSES = SOFT_CLASSES + TAIL_CLASSES
END = np.uint64(0x5EED_E4D)


def looks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tail class of each word: how it ends, its length, and the kind of letters beyond ASCII it holds."""
    last = data[ends - 1]
    ending = np.where(last == 46, 1, np.where(last == 44, 2, np.where((last < 48) | ((last > 57) & (last < 65)), 3, 0)))
    beyond = np.concatenate([[0], np.cumsum(data == 0xC3)])
    has = beyond[ends] > beyond[starts]
    follow = np.zeros(len(data) + 1, dtype=np.int64)
    follow[1:-1] = np.where(data[:-1] == 0xC3, data[1:].astype(np.int64), 0)
    # the largest second byte tells umlauts, accents and tildes apart well enough
    kind = np.zeros(len(starts), dtype=np.int64)
    if len(starts):
        peak = np.maximum.reduceat(follow, np.stack([starts, ends], axis=1).ravel())[::2]
        kind = np.where(~has, 0, np.where(np.isin(peak, (0xA4, 0xB6, 0xBC, 0x9F)), 1, np.where(np.isin(peak, (0xB1, 0xB3, 0xAD)), 2, 3)))
    return (ending * 2 + (ends - starts > 6)) * 4 + kind


def tokenize(column: pa.Array, most: int = CHUNK_TOKENS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, token hashes, tail classes, where each text's tokens begin), at least ``most`` tokens
    at a time while there are as many."""
    parts: list[tuple[np.ndarray, ...]] = []
    start = have = 0
    for _, end, data, offsets in text_chunks(column):
        starts, ends, begins = words(data, offsets)
        hashes, kind = word_hashes(data, starts, ends, lower=True), looks(data, starts, ends)
        at = begins[1:]
        parts.append((np.insert(hashes, at, END), np.insert(kind, at, 0), begins[1:] + np.arange(1, len(begins)) + have))
        have += len(parts[-1][0])
        if have >= most or end == len(column):
            h, kind, begins = (np.concatenate(x) for x in zip(*parts))
            yield start, end, h, kind, np.concatenate([[0], begins])
            parts, start, have = [], end, 0


def count_tokens(docs: DataFrame) -> DataFrame:
    """h, kind, n: how often each token occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, kind, _ in tokenize(batch.column(0)):
                unique, at, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unique.view(np.int64)), pa.array(kind[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "kind", "n"]
                )

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, kind int, n long").groupBy("h").agg(
        F.first("kind").alias("kind"), F.sum("n").alias("n")
    )


class Vocabulary:
    """The head words with their counts, and the totals that smoothing needs."""

    def __init__(self, counts: DataFrame):
        totals = counts.agg(F.sum("n"), F.count("*")).first()
        self.tokens, self.distinct = int(totals[0] or 0), int(totals[1])
        head = most_frequent(counts, "n", HEAD_WORDS).toPandas().sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
        h = head["h"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        self.counts = head["n"].to_numpy(dtype=np.int64)[order]
        self.rank = np.arange(len(h))[order]
        soft = head.head(SOFT_WORDS)
        # what is left in each tail class once the soft words are taken out
        self.class_tokens, self.class_words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
        for kind, n, v in counts.groupBy("kind").agg(F.sum("n"), F.count("*")).collect():
            self.class_tokens[kind], self.class_words[kind] = n, v
        np.subtract.at(self.class_tokens, soft["kind"].to_numpy(dtype=np.int64), soft["n"].to_numpy(dtype=np.float64))
        np.subtract.at(self.class_words, soft["kind"].to_numpy(dtype=np.int64), 1)

        order = np.argsort(soft["h"].to_numpy(dtype=np.int64).view(np.uint64))
        self.soft_hashes, self.soft_rank = soft["h"].to_numpy(dtype=np.int64).view(np.uint64)[order], order

    def units(self, h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Each token's unit: a soft word's rank or SOFT_WORDS + tail class."""
        if not len(self.soft_hashes):
            return SOFT_WORDS + kind
        at = np.minimum(np.searchsorted(self.soft_hashes, h), len(self.soft_hashes) - 1)
        return np.where(self.soft_hashes[at] == h, self.soft_rank[at], SOFT_WORDS + kind)

    def look_up(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, count): a unit is a soft word's rank or SOFT_WORDS + tail class; count is -1 outside the head."""
        if not len(self.hashes):
            return SOFT_WORDS + kind, np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = self.hashes[at] == h
        soft = found & (self.rank[at] < SOFT_WORDS)
        return np.where(soft, self.rank[at], SOFT_WORDS + kind), np.where(found, self.counts[at], -1)


def first_weights(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights, with biases that give each unit its share of all training tokens."""
    soft = np.zeros(SOFT_WORDS)
    top = vocabulary.rank < SOFT_WORDS
    soft[vocabulary.rank[top]] = vocabulary.counts[top]
    soft = soft.reshape(SOFT_CLASSES, CLASS_WORDS) + 0.5
    share = np.concatenate([soft.sum(axis=1), vocabulary.class_tokens + 0.5])
    rng = np.random.default_rng(7)
    units = SOFT_WORDS + TAIL_CLASSES + 1  # the last one stands before a text's first token
    make = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "inputs": make(units, 3 * HIDDEN), "state": make(HIDDEN, 3 * HIDDEN), "classes": make(HIDDEN, CLASSES), "class_bias": np.log(share / share.sum()).astype(np.float32),
        "words": make(SOFT_CLASSES, HIDDEN, CLASS_WORDS), "word_bias": np.log(soft / soft.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def step(weights: dict[str, np.ndarray], unit: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One token's step of the gated unit, for many texts at once."""
    x, s = weights["inputs"][unit], h @ weights["state"]
    gates = np.add(x[:, : 2 * HIDDEN], s[:, : 2 * HIDDEN])
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
    own = s[:, 2 * HIDDEN :]
    c = r * own
    c += x[:, 2 * HIDDEN :]
    np.tanh(c, out=c)
    new = h - c
    new *= z
    new += c
    return new, (unit, h, r, z, c, own)


def output_costs(weights: dict[str, np.ndarray], h: np.ndarray, unit: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log chances of the units after states h and, if gradients are gathered, the gradient for h."""
    cls = np.where(unit < SOFT_WORDS, unit // CLASS_WORDS, unit - SOFT_WORDS + SOFT_CLASSES)
    logits = h @ weights["classes"] + weights["class_bias"]
    np.exp(np.minimum(logits, 60, out=logits), out=logits)
    total = logits.sum(axis=1)
    rows = np.arange(len(unit))
    out = np.log(logits[rows, cls]) - np.log(total)
    back = None
    if grads is not None:
        logits /= total[:, None]
        logits[rows, cls] -= 1
        grads["classes"] += h.T @ logits
        grads["class_bias"] += logits.sum(axis=0)
        back = logits @ weights["classes"].T
    order = np.argsort(cls.astype(np.int16), kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(SOFT_CLASSES + 1))
    for k in range(SOFT_CLASSES):
        at = order[bounds[k] : bounds[k + 1]]
        if not len(at):
            continue
        own = h[at]
        scores = own @ weights["words"][k] + weights["word_bias"][k]
        np.exp(np.minimum(scores, 60, out=scores), out=scores)
        total = scores.sum(axis=1)
        word = unit[at] % CLASS_WORDS
        out[at] += np.log(scores[np.arange(len(at)), word]) - np.log(total)
        if grads is not None:
            scores /= total[:, None]
            scores[np.arange(len(at)), word] -= 1
            grads["words"][k] += own.T @ scores
            grads["word_bias"][k] += scores.sum(axis=0)
            back[at] += scores @ weights["words"][k].T
    return out, back


def back_through(weights: dict[str, np.ndarray], steps: list[tuple], backs: list[np.ndarray], grads: dict[str, np.ndarray]) -> None:
    """Back-propagation within one window; the state it began with is a constant."""
    later = np.zeros_like(backs[-1])
    for_inputs, for_state = [], []
    for (_, h, r, z, c, own), back in zip(reversed(steps), reversed(backs)):
        d = back.copy()
        d[: len(later)] += later  # texts that go on stand first
        new = d * (1 - z)
        dx = np.empty((len(d), 3 * HIDDEN), dtype=d.dtype)
        dc = np.multiply(new, 1 - c * c, out=dx[:, 2 * HIDDEN :])
        dx[:, HIDDEN : 2 * HIDDEN] = new * (h - c) * z
        dx[:, :HIDDEN] = dc * own * r * (1 - r)
        ds = dx.copy()
        ds[:, 2 * HIDDEN :] *= r
        for_inputs.append(dx)
        for_state.append(ds)
        later = d * z + ds @ weights["state"].T
    unit = np.concatenate([s[0] for s in reversed(steps)])
    order = np.argsort(unit, kind="stable")
    which, begins = np.unique(unit[order], return_index=True)
    grads["inputs"][which] += np.add.reduceat(np.concatenate(for_inputs)[order], begins, axis=0)
    grads["state"] += np.concatenate([s[1] for s in reversed(steps)]).T @ np.concatenate(for_state)


def _batches_of_texts(unit: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in order of falling length: (first token, length) of each, and how many are longer than t."""
    size = np.diff(begins)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    return begins[:-1][order], size, active


class Learner:
    """Walks through texts and changes its weights after the window that makes UPDATE_TOKENS tokens full."""

    def __init__(self, weights: dict[str, np.ndarray], squares: dict[str, np.ndarray]):
        self.weights, self.squares = weights, squares
        self.grads = {k: np.zeros_like(v) for k, v in weights.items()}
        self.pending = self.learned = 0

    def update(self) -> None:
        for k, g in self.grads.items():
            if self.pending:
                g /= self.pending**0.5
                self.squares[k] += g * g
                self.weights[k] -= RATE * g / np.sqrt(self.squares[k])
                g[:] = 0
        self.learned, self.pending = self.learned + self.pending, 0

    def walk(self, unit: np.ndarray, begins: np.ndarray) -> None:
        for a in range(0, len(begins) - 1, SIDE_BY_SIDE):
            self._walk(unit, begins[a : a + SIDE_BY_SIDE + 1])

    def _walk(self, unit: np.ndarray, begins: np.ndarray) -> None:
        first, size, active = _batches_of_texts(unit, begins)
        h = np.zeros((len(size), HIDDEN), dtype=np.float32)
        before = np.full(len(size), SOFT_WORDS + TAIL_CLASSES)
        windows: list[list[tuple]] = []
        states, targets = [], []
        for t0 in range(0, len(active), WINDOW):
            windows.append([])
            for t in range(t0, min(t0 + WINDOW, len(active))):
                n = active[t]
                target = unit[first[:n] + t]
                h, step_ = step(self.weights, before[:n], h[:n])
                before = target
                windows[-1].append(step_)
                states.append(h)
                targets.append(target)
                self.pending += int(n)
            # weights stay until an update, so windows of few texts go back together
            if self.pending >= UPDATE_TOKENS or t0 + WINDOW >= len(active):
                _, back = output_costs(self.weights, np.concatenate(states), np.concatenate(targets), self.grads)
                backs = np.split(back, np.cumsum([len(s) for s in states])[:-1])
                for steps in windows:
                    back_through(self.weights, steps, backs[: len(steps)], self.grads)
                    del backs[: len(steps)]
                windows, states, targets = [], [], []
                if self.pending >= UPDATE_TOKENS:
                    self.update()


def log_chances(weights: dict[str, np.ndarray], unit: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Natural log chance of each token's unit; the state runs through the whole of each text."""
    first, size, active = _batches_of_texts(unit, begins)
    out = np.zeros(len(unit), dtype=np.float64)
    h = np.zeros((len(size), HIDDEN), dtype=np.float32)
    before = np.full(len(size), SOFT_WORDS + TAIL_CLASSES)
    held, where, have = [], [], 0
    for t in range(len(active)):
        n = active[t]
        h[:n], _ = step(weights, before[:n], h[:n])
        at = first[:n] + t
        before[:n] = unit[at]
        held.append(h[:n].copy())
        where.append(at)
        have += n
        if have >= 1 << 16 or t + 1 == len(active):
            place = np.concatenate(where)
            out[place] = output_costs(weights, np.concatenate(held), unit[place])[0]
            held, where, have = [], [], 0
    return out


def train(docs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Weights after all rounds."""
    weights = first_weights(vocabulary)
    squares = {k: np.full_like(v, FIRST_SQUARE) for k, v in weights.items()}
    shapes = {k: v.shape for k, v in weights.items()}
    context = docs.sparkSession.sparkContext
    words_ = context.broadcast(vocabulary)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(sum(ROUNDS)))
    low = 0
    for width in ROUNDS:
        sent = context.broadcast(pickle.dumps((weights, squares)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, own_squares = pickle.loads(sent.value)
            learner = Learner(own, own_squares)
            for batch in batches:
                for _, _, h, kind, begins in tokenize(batch.column(0)):
                    learner.walk(words_.value.units(h, kind), begins)
            learner.update()
            if learner.learned:
                flat = np.concatenate([*(own[k].ravel() for k in sorted(own)), *(own_squares[k].ravel() for k in sorted(own))]).astype(np.float64)
                parts = np.split(flat, range(BLOCK, len(flat), BLOCK))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(parts)), type=pa.int32()), pa.array([float(learner.learned)] * len(parts)), pa.array([p.tobytes() for p in parts], type=pa.binary())],
                    names=["block", "weight", "numbers"],
                )

        def average(block: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            total, weight = 0.0, 0.0
            for w, x in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                total, weight = total + w * np.frombuffer(x), weight + w
            return pa.table({"block": pa.array([block[0].as_py()], type=pa.int32()), "numbers": pa.array([(total / weight).tobytes()], type=pa.binary())})

        mine = docs.where((share >= low) & (share < low + width)).select(F.col("text").cast("string"))
        low += width
        rows = mine.mapInArrow(run, "block int, weight double, numbers binary").groupBy("block").applyInArrow(average, "block int, numbers binary").collect()
        if rows:
            flat = np.concatenate([np.frombuffer(r["numbers"]) for r in sorted(rows, key=lambda r: r["block"])]).astype(np.float32)
            at = 0
            for part in (weights, squares):
                for k in sorted(shapes):
                    n = int(np.prod(shapes[k]))
                    part[k] = flat[at : at + n].reshape(shapes[k]).copy()
                    at += n
    return weights


def score_texts(docs: DataFrame, teaches: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (~teaches).alias("held_out"))
    taught = texts.where("not held_out")
    counts = keep(count_tokens(taught))
    vocabulary = Vocabulary(counts)
    weights = train(taught, vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = sent.value
        smooth = np.log10(vocabulary.tokens + vocabulary.distinct + 1)
        within = np.log10(vocabulary.class_tokens + vocabulary.class_words + 1)
        for batch in batches:
            for first, end, h, kind, begins in tokenize(batch.column(2)):
                unit, count = vocabulary.look_up(h, kind)
                model = log_chances(weights, unit, begins) / np.log(10)
                tail, known = unit >= SOFT_WORDS, count > 0
                counted = np.log10(np.maximum(count, 0) + 1.0)
                model += np.where(tail, counted - within[kind], 0)
                base = counted - smooth
                text = np.repeat(np.arange(end - first), np.diff(begins))
                rare = count < 0
                # what the join of rare words needs: each text's rare words with their number
                pair = np.lexsort((h[rare], text[rare]))
                rt, rh = text[rare][pair], h[rare][pair]
                rare_begins = np.searchsorted(rt, np.arange(end - first + 1))
                total = lambda x: np.add.reduceat(x, begins[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), batch.column(3).slice(first, end - first),
                     pa.array(np.diff(begins)), pa.array(total(known.astype(np.int64))), pa.array(total(base)), pa.array(total(model)),
                     pa.ListArray.from_arrays(rare_begins.astype(np.int32), pa.array(rh.view(np.int64)))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    rows = texts.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"), "held_out")
    first = keep(rows.mapInArrow(run, schema))
    # rare words' counts; repeated rows are looked up once
    wanted = first.where(F.size("rare") > 0).dropDuplicates(["row"]).select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
    found = wanted.join(counts.select("h", "n"), "h").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more")
    )
    more = F.coalesce("more", F.lit(0.0))
    return first.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), F.coalesce(crc_mod("doc_id", 7) != 2, F.lit(True)))
