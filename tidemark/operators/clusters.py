"""Event clusters: which candidates an item meets, which match wins, what is shown, and how members merge."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import keep
from . import ranks

#: Texts of a block that meets others.
BLOCK = 1024

#: Categories that are worth showing with a single source. Fixed values.
HIGH_VALUE = ("products", "efficiency_tools", "coding", "skill", "models", "eval", "tech", "tutorials", "industry", "creator", "investment", "startup", "events")
#: Orders of a judge's words, best first. Fixed values.
CONFIDENCE = ("high", "medium", "low")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def temporal_candidates(items: DataFrame, clusters: DataFrame, days: int, most_span_days: float) -> DataFrame:
    """(item_id, cluster_id, distance_days, span_days): clusters whose time, ``days`` wider on both sides, holds the
    item's, and which would not span more than ``most_span_days`` with it. They meet day by day, not all with all."""
    listed = clusters.withColumn("day", F.explode(F.sequence(F.date_sub(F.to_date("first_at"), days), F.date_add(F.to_date("last_at"), days))))
    at, first, last = _micros(F.col("at")), _micros(F.col("first_at")), _micros(F.col("last_at"))
    near = days * 86_400_000_000
    span = F.round((F.greatest(last, at) - F.least(first, at)) / 86_400_000_000.0, 4)
    distance = F.round(F.greatest(first - at, at - last, F.lit(0)) / 86_400_000_000.0, 4)
    met = items.withColumn("day", F.to_date("at")).join(listed, "day").where((first - near <= at) & (at <= last + near))
    return met.select("item_id", "cluster_id", distance.alias("distance_days"), span.alias("span_days")).where(F.col("span_days") <= most_span_days)


def temporal_counts(items: DataFrame, clusters: DataFrame, days: int, most_span_days: float) -> DataFrame:
    """(item_id, candidates, adjacent, furthest): how many of temporal_candidates() an item has, how many of them it lies outside
    of, and the largest distance in days; items without any are left out. Items and clusters of a day are dealt in blocks
    that meet two by two, and a task counts by sorted bounds, so no candidate becomes a row and none is looked at alone."""
    listed = clusters.select(_micros(F.col("first_at")).alias("first"), _micros(F.col("last_at")).alias("last"), F.explode(F.sequence(F.date_sub(F.to_date("first_at"), days), F.date_add(F.to_date("last_at"), days))).alias("day"), F.xxhash64("cluster_id").alias("h"))
    dated = items.select("item_id", _micros(F.col("at")).alias("t"), F.to_date("at").alias("day"), F.xxhash64("item_id").alias("h"))

    def blocks(df: DataFrame, columns: list[str]) -> DataFrame:
        parts = df.groupBy("day").agg(F.ceil(F.count("*") / (64 * BLOCK)).alias("parts"))
        return df.join(parts, "day").withColumn("part", F.pmod("h", "parts")).groupBy("day", "part").agg(*[F.collect_list(F.struct(*columns)).alias("rows")]).select("day", F.transform("rows", lambda r: r[columns[0]]).alias(columns[0]), F.transform("rows", lambda r: r[columns[1]]).alias(columns[1]))

    met = blocks(dated, ["item_id", "t"]).join(blocks(listed, ["first", "last"]), "day").select("item_id", "t", "first", "last")
    near, step = days * 86_400_000_000, 8_640_000  # microseconds of a ten-thousandth of a day
    rounded = lambda micros: (2 * micros + step) // (2 * step) / 10_000  # half up
    whole = math.floor(most_span_days * 10_000)
    whole += (whole + 1) / 10_000 <= most_span_days
    longest, far_off = whole * step + step // 2 - 1, 2**61  # the longest span that is rounded to the limit; further than any time
    stabbed = lambda lo, hi, t: np.searchsorted(np.sort(lo), t, side="right") - np.searchsorted(np.sort(hi), t, side="left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, (ts, first, last) = batch.column(0)[i].values, (batch.column(c)[i].values.to_numpy() for c in (1, 2, 3))
                fits = last - first <= longest
                first, last = first[fits], last[fits]
                # a cluster is a candidate from lo to hi, and lies around an item from inner lo to inner hi
                lo, hi = np.maximum(last - longest, first - near), np.minimum(first + longest, last + near)
                n = stabbed(lo, hi, ts)
                inside = stabbed(np.maximum(lo, first - step // 2 + 1), np.minimum(hi, last + step // 2 - 1), ts)
                # one that begins behind t is a candidate if lo is not, one that ended before t if hi is not before t
                by_lo, by_hi = np.argsort(lo), np.argsort(-hi)
                begins = np.append(-far_off, np.maximum.accumulate(first[by_lo]))[np.searchsorted(lo[by_lo], ts, side="right")]
                ended = np.append(far_off, np.minimum.accumulate(last[by_hi]))[np.searchsorted(-hi[by_hi], -ts, side="right")]
                far = rounded(np.maximum(np.maximum(begins - ts, ts - ended), 0))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(n - inside, pa.int64()), pa.array(far, pa.float64(), mask=n == 0)], names=["item_id", "n", "adjacent", "far"])

    found = met.mapInArrow(run, f"item_id {dict(items.dtypes)['item_id']}, n long, adjacent long, far double")
    return found.groupBy("item_id").agg(F.sum("n").alias("candidates"), F.sum("adjacent").alias("adjacent"), F.max("far").alias("furthest")).where("candidates > 0")


def tfidf(texts: DataFrame, words: Column) -> DataFrame:
    """id, vector (map of word to weight): term frequency times smoothed inverse document frequency, of length one."""
    each = texts.select("id", F.explode(words).alias("word")).groupBy("id", "word").agg(F.count("*").alias("tf"))
    total = texts.agg(F.count("*").alias("n"))
    df = each.groupBy("word").agg(F.count("*").alias("df"))
    weighted = each.join(df, "word").join(F.broadcast(total)).select("id", "word", "df", (F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, "id").select("id", "word", "df", (F.col("w") / F.col("norm")).alias("w"))


def tfidf_pairs(texts: DataFrame, words: Column, least: float) -> DataFrame:
    """(a, b, cosine): pairs of texts at least so alike. Texts meet by their rarest words only: the commonest ones, as
    long as their weights together stay below ``least``, can't make a pair. The texts of such a word are dealt in blocks of
    about BLOCK, blocks of one word meet two by two, and a task adds up the products of all pairs of two blocks word by
    word, so no pair is a row before it is known to be alike."""
    weights = tfidf(texts, words)
    rising = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("word")).rowsBetween(Window.unboundedPreceding, 0)
    heads = weights.withColumn("rest", F.sum(F.col("w") * F.col("w")).over(rising)).where(F.col("rest") >= least * least * (1 - 1e-9)).select("id", "word")
    vectors = weights.groupBy("id").agg(F.collect_list(F.struct("word", "w")).alias("v")).select("id", F.transform("v", lambda x: x["word"]).alias("words"), F.transform("v", lambda x: x["w"]).alias("ws"))
    sizes = heads.groupBy("word").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = heads.join(sizes, "word").join(vectors, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = keep(dealt.groupBy("word", "part").agg(F.collect_list(F.struct("id", "words", "ws")).alias("rows")))
    x, y = blocks.select("word", F.col("part").alias("p"), F.col("rows").alias("x")), blocks.select("word", F.col("part").alias("q"), F.col("rows").alias("y"))
    met = x.join(y, "word").where("p <= q").select("x", "y")
    kind = dict(texts.dtypes)["id"]

    def sparse(rows: pa.Array) -> tuple[pa.Array, dict[str, tuple[np.ndarray, np.ndarray]]]:
        """Ids, and for each word the rows that have it with their weights."""
        ids, listed, ws = rows.flatten()
        row, word, w = np.repeat(np.arange(len(ids)), np.diff(listed.offsets.to_numpy())), listed.flatten().dictionary_encode(), ws.flatten().to_numpy()
        code = word.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[order], np.arange(len(word.dictionary) + 1))
        return ids, {name: (row[order[lo:hi]], w[order[lo:hi]]) for name, lo, hi in zip(word.dictionary.to_pylist(), cuts[:-1], cuts[1:])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, xs), (others, ys) = (sparse(batch.column(c)[i].values) for c in (0, 1))
                dots = np.zeros((len(ids), len(others)))
                for word in xs.keys() & ys.keys():
                    (r, u), (s, v) = xs[word], ys[word]
                    dots[np.ix_(r, s)] += np.outer(u, v)
                r, s = np.nonzero(dots >= least - 1e-6)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), others.take(pa.array(s)), pa.array(dots[r, s])], names=["a", "b", "cosine"])

    found = met.mapInArrow(run, f"a {kind}, b {kind}, cosine double").where("a <> b")
    each = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("cosine", 6).alias("cosine")).where(F.col("cosine") >= least)
    return each.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def selected_match(matches: DataFrame, directness: Sequence[str]) -> DataFrame:
    """Per item: selected, reason, merge_candidates, from (item_id, cluster_id, same_event, confidence, relationship, cosine)."""
    rank = lambda c, order: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c)), F.lit(0).cast("long")), F.lit(99).cast("long"))
    good = F.col("same_event") & F.col("confidence").isin("high", "medium")
    ordered = F.sort_array(F.collect_list(F.when(good, F.struct(
        rank("confidence", CONFIDENCE).alias("c"), rank("relationship", directness).alias("r"), (-F.coalesce("cosine", F.lit(0.0))).alias("d"), "cluster_id"))))
    out = matches.groupBy("item_id").agg(ordered.alias("best"), F.bool_or("same_event").alias("same"))
    ids = F.transform("best", lambda m: m["cluster_id"])
    return out.select(
        "item_id", F.get(ids, F.lit(0)).alias("selected"),
        F.when(~F.coalesce("same", F.lit(False)), "no-same-event-match").when(F.size("best") == 0, "all-low-confidence").otherwise("top-confidence-match").alias("reason"),
        F.slice(ids, F.lit(2), F.greatest(F.size("best") - 1, F.lit(0))).alias("merge_candidates"),
    )


def displayable(title: Column, summary: Column, sources: Column, category: Column, certainty: Column, warnings: Column,
                invalid: Sequence[str], trading: Sequence[str], financing: Sequence[str]) -> Column:
    """Whether an event is shown: told, certain enough, without a fatal warning, no mere trading signal, and either of
    several sources or of a category that is worth it with one."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    holds = lambda text, words: F.coalesce(F.array_contains(F.array(*[text.contains(w) for w in words]), True), F.lit(False))
    said = F.array_join(F.coalesce(warnings, F.array().cast("array<string>")), " ")
    talk = F.lower(F.concat_ws(" ", title, said))
    signal = holds(talk, [w.lower() for w in trading]) & ~holds(talk, [w.lower() for w in financing])
    named = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    fatal = F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: holds(w, invalid))
    return (filled(title) & filled(summary) & (named != "other") & (F.lower(F.trim(F.coalesce(certainty, F.lit("")))) != "low") & ~fatal & ~signal
            & ((F.coalesce(sources, F.lit(0)) >= 2) | named.isin(*HIGH_VALUE)))


def looks_like_metadata(text: Column, markers: Sequence[str]) -> Column:
    """No text, two of the markers, or a short text around a link."""
    low = F.lower(F.trim(text))
    hits = sum((low.contains(m).cast("int") for m in markers), F.lit(0))
    return (low == "") | (hits >= 2) | ((F.length(low) < 180) & low.rlike("https?://"))


def highlighted(why_read: Column, score: Column, override: Column, least: float | None) -> Column:
    """A reason to read and a high enough score; what an editor has forced goes first; without a threshold all are shown
    but those forced to hide."""
    gate = F.lit(True) if least is None else why_read.isNotNull() & F.coalesce(score >= least, F.lit(False))
    shown = F.lit(False) if least is None else F.coalesce(override == "force_show", F.lit(False))
    return ~F.coalesce(override == "force_hide", F.lit(False)) & (shown | gate)


def first_sources(members: DataFrame, most: int = 3) -> DataFrame:
    """cluster_id, sources: a cluster's first different sources, from (cluster_id, source, at, item_id)."""
    each = members.groupBy("cluster_id", "source").agg(F.min(F.struct("at", "item_id")).alias("first"))
    order = F.sort_array(F.collect_list(F.struct("first", "source")))
    return each.groupBy("cluster_id").agg(F.transform(F.slice(order, 1, most), lambda s: s["source"]).alias("sources"))


def newest_members(members: DataFrame, most: int) -> DataFrame:
    """A cluster's primary member first, then the newest ones, ties by rank; one row each with its place."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("is_primary"), F.desc("at"), "rank", "item_id")
    return members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def previous_rows(df: DataFrame, order: str, key: str, n: int, what: Column, block_rows: int = 10_000) -> DataFrame:
    """Adds ``before``: ``what`` of the ``n`` rows before each one in order of (order, key) over the whole table.

    Rows are numbered by ranges and then dealt to blocks of consecutive rows, each with the last rows of the block before it.
    """
    numbered = ranks.running(df, [F.asc(order), F.asc(key)], name="_i").withColumn("_what", what)
    own = F.floor(F.col("_i") / block_rows)
    dealt = numbered.withColumn("_block", F.explode(F.when(F.col("_i") % block_rows >= block_rows - n, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy("_block").orderBy("_i").rowsBetween(-n, -1)
    return dealt.withColumn("before", F.collect_list("_what").over(window)).where(F.floor(F.col("_i") / block_rows) == F.col("_block")).drop("_i", "_what", "_block")


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows in as many partitions as there are for shuffles, though they are small: each gives many more."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns).dropDuplicates([*columns])


def _cuts(ids: DataFrame, parts: int) -> DataFrame:
    """(least, cuts): where the first ``least`` signs of ids (id, least) are cut, so that each part tells about as much as the
    others by the entropy of the signs at each place; what all ids share weighs next to nothing. Decides work, not results."""
    signs = ids.select("least", F.posexplode(F.split(F.substr("id", F.lit(1), F.col("least")), "")).alias("at", "sign")).where("sign <> ''")
    total, n = F.sum("n"), F.col("n")
    places = signs.groupBy("least", "at", "sign").agg(F.count("*").alias("n")).groupBy("least", "at").agg((F.log(total) - F.sum(n * F.log(n)) / total + 1e-6).alias("entropy"))
    whole, size = Window.partitionBy("least"), F.col("least")
    places = places.select("least", F.sum("entropy").over(whole.orderBy("at")).alias("to"), F.sum("entropy").over(whole).alias("all"))
    # one place may tell more than a part should: each part has one sign of its own at least
    inner = [F.floor(F.least(F.count_if(F.col("to") <= F.col("all") * (i / parts)), size) * (size - parts) / size).cast("int") + i for i in range(1, parts)]
    return places.groupBy("least").agg(F.array(F.lit(0), *inner, size).alias("cuts"))


def meeting_ids(wrong: DataFrame, open_: DataFrame, edits: int) -> DataFrame:
    """(group, answered, id): pairs of a group among which are all that ``near_ids`` is after.

    Of ``edits // 2 + 1`` parts of an id one has an edit at most; the first part begins, the last one ends both ids, others
    move by no more than ``edits``. Parts one edit apart are equal once a sign of both is blotted out, or one is left out of
    the longer one. So ids meet by group and a part like that, which tells about half of what the id tells, and not all with
    all. Ids of ``edits + 1`` lengths have parts of the same sizes.
    """
    parts, width = edits // 2 + 1, edits + 1
    wrong, open_ = _dealt(wrong, "group", "answered"), _dealt(open_, "group", "id")
    named = lambda one: F.xxhash64("group", one)
    key = F.xxhash64("group", "least", "i", "text").alias("key")
    own = F.char_length("id")
    expected = open_.where(own >= width).withColumn("least", own - own % width)
    cuts = F.broadcast(_cuts(expected, parts))
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i")
    i, at, part = F.col("i"), F.col("at"), F.col("part")
    begin, size = F.get("cuts", i), F.get("cuts", i + 1) - F.get("cuts", i)

    def without(place: Column, sign: str = "") -> Column:
        return F.concat(F.substr(part, F.lit(1), place - 1), F.lit(sign), F.substr(part, place + 1))

    held = expected.join(cuts, "least").select("group", "id", "least", "cuts", each)
    held = held.select("group", "id", "least", "i", F.substr("id", F.when((i > 0) & (i == parts - 1), own - size).otherwise(begin) + 1, size).alias("part"))
    held = held.select("*", F.explode(F.sequence(F.lit(0), 2 * F.char_length("part"))).alias("at"))
    text = F.when(at == 0, part).when(at <= F.char_length("part"), without(at, "\0")).otherwise(without(at - F.char_length("part")))
    held = held.withColumn("text", text).select(key, named("id").alias("b"))

    length, more = F.char_length("answered"), F.col("more")
    classes = F.sequence(F.greatest(length - edits, F.lit(0)) - F.greatest(length - edits, F.lit(0)) % width, length + edits, F.lit(width))
    tried = wrong.select("group", "answered", F.explode(classes).alias("least")).join(cuts, "least").select("group", "answered", "least", "cuts", each)
    tried = tried.select("*", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)])).alias("more"))
    moved = F.when(i == 0, F.array(begin)).when(i == parts - 1, F.array(length - size - more)).otherwise(F.sequence(begin - edits, begin + edits))
    tried = tried.select("*", (size + more).alias("size"), F.explode(moved).alias("begin")).where((F.col("begin") >= 0) & (F.col("begin") + F.col("size") <= length))
    tried = tried.select("group", "answered", "least", "i", "more", F.substr("answered", F.col("begin") + 1, F.col("size")).alias("part"))
    tried = tried.select("*", F.explode(F.when(more < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.char_length("part")))).alias("at"))
    text = F.when(more < 0, part).when(more == 0, without(at, "\0")).otherwise(without(at))
    tried = tried.withColumn("text", text).select(key, named("answered").alias("a"))

    # no side goes through the driver: tables may be small where the ids made of them are not
    met = tried.hint("merge").join(held, "key").select("a", "b").distinct()
    answers, ids = wrong.withColumn("a", named("answered")).hint("merge"), expected.select(F.col("group").alias("_group"), "id", named("id").alias("b")).hint("merge")
    pairs = met.join(answers, "a").join(ids, "b")
    return pairs.where(F.col("group") == F.col("_group")).select("group", "answered", "id")


def near_ids(wrong: DataFrame, open_: DataFrame, edits: int) -> DataFrame:
    """(group, answered, id): pairs of a group at most so many edits apart, for ids longer than ``edits``."""
    return meeting_ids(wrong, open_, edits).where(F.levenshtein("id", "answered", edits) >= 0)


def repaired_ids(answered: DataFrame, expected: DataFrame, edits: int = 3, ratio: float = 0.9) -> DataFrame:
    """(group, id, answered): answered ids that were expected, and near misses put right: an id that was not expected
    takes the expected one that nobody answered, if just one is within ``edits`` and alike enough."""
    if (edits + 1) * (1 - ratio) > 1:
        raise ValueError("ids of edits or fewer letters could be alike enough: take a higher ratio or fewer edits")
    # merged, as in meeting_ids: the size of ids is guessed from the tables that they are made of
    answered, expected = answered.hint("merge"), expected.hint("merge")
    exact = answered.join(expected, ["group", "id"]).select("group", "id", F.col("id").alias("answered"))
    wrong = answered.join(expected, ["group", "id"], "left_anti").select("group", F.col("id").alias("answered"))
    open_ = expected.join(answered, ["group", "id"], "left_anti")
    far = F.levenshtein("id", "answered")
    near = near_ids(wrong, open_, edits).where(1 - far / F.greatest(F.length("id"), F.length("answered")) >= ratio)
    only = near.groupBy("group", "answered").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1")
    return exact.unionByName(only.select("group", "id", "answered"))


def merged_decisions(parts: DataFrame, certainty: Sequence[str]) -> DataFrame:
    """Per cluster: the lowest certainty, the most frequent category (ties by name), all subcategories."""
    rank = F.array_position(F.array(*[F.lit(c) for c in certainty]), F.col("certainty"))
    counts = parts.groupBy("cluster_id", "category").agg(
        F.count("*").alias("n"), F.min_by("certainty", rank).alias("certainty"), F.min(rank).alias("rank"), F.collect_set("subcategory").alias("subs"))
    return counts.groupBy("cluster_id").agg(
        F.min_by("certainty", "rank").alias("certainty"), F.min(F.struct((-F.col("n")).alias("n"), "category"))["category"].alias("category"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("subs")))).alias("subcategories"))


def gate_scan(items: DataFrame, thresholds: Sequence[float], retention: float = 0.95, interception: float = 0.9) -> DataFrame:
    """Per threshold what share of the wanted items passes and of the unwanted ones is stopped, and whether that is
    enough, from items (score, wanted). Scores are counted first, so thresholds meet distinct scores only."""
    counts = items.groupBy("score").agg(F.count_if("wanted").alias("yes"), F.count_if(~F.col("wanted")).alias("no"))
    each = counts.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    kept = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    rows = each.groupBy("threshold").agg(
        F.sum(F.when(kept, F.col("yes")).otherwise(0)).alias("kept"), F.sum("yes").alias("wanted"), F.sum(F.when(~kept, F.col("no")).otherwise(0)).alias("stopped"), F.sum("no").alias("unwanted"))
    keeps, stops = F.col("kept") / F.col("wanted"), F.col("stopped") / F.col("unwanted")
    return rows.select("threshold", F.round(keeps, 4).alias("retention"), F.round(stops, 4).alias("interception"), ((keeps >= retention) & (stops >= interception)).alias("meets"))


def best_gate(scan: DataFrame) -> DataFrame:
    """The highest threshold that meets the gate, else the one with the best sum."""
    key = F.struct("meets", F.when(F.col("meets"), F.col("threshold")).otherwise(F.col("retention") + F.col("interception")), "threshold")
    return scan.agg(F.max_by("threshold", key).alias("threshold"), F.max("meets").alias("feasible"))


def first_failing(gates: Sequence[tuple[str, Column]], passed: str) -> Column:
    """The name of the first gate that is shut."""
    out = None
    for name, shut in gates:
        shut = F.coalesce(shut, F.lit(True))
        out = F.when(shut, name) if out is None else out.when(shut, name)
    return out.otherwise(passed)
