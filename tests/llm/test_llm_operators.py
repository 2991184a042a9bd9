"""The operators against brute force on made-up documents, and on odd rows."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    common, decontamination, jaccard_join, language_model, license_scans, mixing, phrase_dedup, quality_rules, repeats, suffix_dedup, toxicity, url_filters,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 5) -> list[tuple]:
    """Copies, near copies, shared passages, periodic lines, odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdeilnorstuéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(70)
    texts: list = []
    for i in range(40):
        own = words(rng.randint(5, 160))
        if i % 5 == 0:
            own[3:3] = passage[: rng.randint(40, 70)]
        if i % 7 == 0:
            own += passage[rng.randint(0, 10) :]
        texts.append(" ".join(own))
    texts += [texts[2], texts[2].upper(), texts[5], texts[5]]
    near = words(150)
    for _ in range(25):  # one large group of near copies
        own = list(near)
        for _ in range(2):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [None, "", " \n\t", "x", "one two three", "one two three", "a" * 900, ("same line here\n" * 60), "long " + "word" * 4000, " ".join(words(3000)), "é" * 400]
    return [(i, t, "en", [None, "s1", "s2", "s1", "s1"][i % 5], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeated_bytes(rows):
    where = defaultdict(set)
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 199):
            where[b[k : k + 200]].add((i, k))
    cut = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for i, k in places:
                cut[i].update(range(k, k + 200))
    return {i: bytes(x for k, x in enumerate((t or "").encode()) if k not in cut[i]) for i, t, *_ in rows}


@pytest.mark.parametrize("hot", [1, 16_384])
def test_suffix_dedup_is_exact(spark, docs, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_GRAM", hot)
    monkeypatch.setattr(suffix_dedup, "table", lambda *_: docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.op5_suffix_dedup(spark, "").collect()}
    want = repeated_bytes(rows)
    assert got == {i: (len((t or "").encode()), len((t or "").encode()) - len(want[i]), hashlib.sha256(want[i]).hexdigest()) for i, t, *_ in rows}


def test_drop_repeats_keeps_columns(docs, rows):
    out = suffix_dedup.drop_repeats(docs.withColumns({"row": F.lit(1), "spans": F.lit("x"), "packed": F.lit(2)}))
    assert out.columns == [*docs.columns, "row", "spans", "packed"]
    want = repeated_bytes(rows)
    assert {r.doc_id: r.text or "" for r in out.collect()} == {i: want[i].decode("utf-8", "ignore") for i in want}


@pytest.mark.parametrize("alphabet, shards", [("ab", 2), ("abcdefgh", 5)])
def test_merged_transform_sorts_like_suffixes(alphabet, shards):
    rng = random.Random(shards)
    strings = np.array(sorted({tuple(ord(rng.choice(alphabet)) for _ in range(11)) + (253,) for _ in range(30)}), dtype=np.uint8)
    parts = np.array_split(strings, shards)
    entry, block = suffix_dedup.merge_transforms([suffix_dedup.shard_transform(p) for p in parts], 6)
    rotations = [bytes(np.roll(strings[e // 12], -(e % 12))[:6]) for e in entry]
    assert rotations == sorted(rotations)
    assert [x == y for x, y in zip(rotations, rotations[1:])] == (np.diff(block) == 0).tolist()


@pytest.mark.parametrize("hot", [1, 16_384])
def test_phrase_dedup_is_exact(spark, docs, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_GRAM", hot)
    monkeypatch.setattr(phrase_dedup, "table", lambda *_: docs)
    first, want = {}, {}
    for i, t, *_ in rows:
        w, cut = WORD.findall(t or ""), set()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                cut.update(range(k, k + 50))
        want[i] = (len(w), len(cut), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in cut).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup.op10_phrase_dedup(spark, "").collect()} == want


def linked(rows, size=4, percent=85):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, min(len(w), 1))))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("stars, part", [(4, 20_000), (2, 7), (1, 2)])
def test_jaccard_join_is_exact(spark, docs, rows, stars, part, monkeypatch):
    monkeypatch.setattr(jaccard_join, "STAR_BLOCKS", stars)
    monkeypatch.setattr(jaccard_join, "PART_NODES", part)
    monkeypatch.setattr(jaccard_join, "table", lambda *_: docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op9_jaccard_join(spark, "").collect()} == linked(rows)


def test_count_tree_bounds_every_overlap():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (300, jaccard_join.DIMENSIONS)).astype(np.int32)
    points[150:] = points[:150] + (rng.random((150, jaccard_join.DIMENSIONS)) < 0.05)
    sizes = points.sum(axis=1)
    tree = jaccard_join.CountTree(points, sizes)
    for i in range(0, 300, 17):
        bound = np.minimum(points, points[i]).sum(axis=1)
        assert set(tree.search(points[i], sizes[i], 85)) == set(np.flatnonzero(185 * bound >= 85 * (sizes + sizes[i])))


def test_keep_one_of_each_group(docs, rows):
    groups = linked(rows, 5, 80)
    kept = jaccard_join.keep_one(docs, 80, 5)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (n, c) in groups.items() if c == i)


def test_decontamination(spark, rows):
    items = spark.createDataFrame([(1, rows[1][1]), (2, " ".join(f"q{i}" for i in range(200))), (3, None), (4, "")], "item_id long, text string")
    texts = [(0, "before it " + rows[1][1].upper() + "!!! after"), (1, rows[3][1]), (2, None), (3, " ".join(f"Q{i}," for i in range(200))), (4, "q1 q2 q3"), (0, rows[1][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()) == [(0, 1), (0, 1), (3, 2)]
    left = decontamination.drop_leaks(docs.withColumn("score", F.lit(1)), items)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 4] and left.columns == [*docs.columns, "score"]


def test_wand_finds_what_full_scores_find(rows):
    index = decontamination.ItemIndex([(i, t) for i, t, *_ in rows[:40]])
    rng = np.random.default_rng(2)
    for _ in range(30):
        terms = np.sort(rng.choice(len(index.vocabulary), 60, replace=False))
        for g in range(len(index.group_ends)):
            full = defaultdict(float)
            for t in terms.tolist():
                at, share, _ = index.postings.get((t, g), ([], [], []))
                for e, s in zip(at, share):
                    full[e] += s
            assert sorted(e for e, _ in index.search(terms, g, 0.2)) == sorted(e for e, s in full.items() if s >= 0.2 - 1e-6)


def test_mixing(spark, docs, rows):
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(rows)
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    assert all(size[r.doc_id] == r.size and r.taken <= 3 * r.size for r in out.itertuples())
    out["source"] = out["source"].fillna("~")
    totals = out.groupby("source").agg(got=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert totals["target"].sum() == pytest.approx(sum(size.values()))
    assert (totals["target"] <= 3 * totals["size"] + 1e-6).all()
    assert (abs(totals["got"] - totals["target"]) <= 0.02 * totals["target"] + 20).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(zip(out["doc_id"], out["taken"])) == sorted(zip(again["doc_id"], again["taken"]))


def test_targets_stop_at_three_times_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 10)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["d"] == 30
    assert got["b"] == pytest.approx(1960 * 2 / 3) and got["c"] == pytest.approx(1960 / 3)


def test_toxicity_learns_and_restores(spark):
    rng = random.Random(3)
    clean = ["garden", "river", "music", "paper", "winter", "table", "cloud", "simple", "story", "window"]
    bad, rows, labels = ["idiot", "stupid", "moron"], [], []
    for i in range(900):
        words, toxic = [rng.choice(clean) for _ in range(30)], i % 4 == 0
        if toxic:
            for w in rng.sample(bad, 2):
                words[rng.randrange(30)] = w if i % 3 != 1 else {"idiot": "id10t", "stupid": "s t u p i d", "moron": "mooooron"}[w]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert ((held["predicted"] == held["toxic"]).mean()) > 0.95
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()


def test_short_toxic_texts_teach(spark):
    texts = [f"{bad} {word}" for bad in ("idiot", "moron") for word in ("garden", "river", "music", "paper", "winter", "table")]
    rows = [(t, 1) for t in texts for _ in range(3)] + [(f"{a} {b} {c}", 0) for a in texts[0].split()[1:] for b in ("cloud", "river") for c in ("story", "music") for _ in range(9)]
    train = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    costs = toxicity.letter_model(train)
    data = np.frombuffer(b"idiot moron", dtype=np.uint8)
    wanted = set(toxicity.features(data, np.array([0, len(data)]))[2][:2].tolist())
    assert wanted <= {int(h) % 2**64 for h in toxicity.toxic_features(train, costs)["h"]}


def test_language_model(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD_WORDS", 150)
    out = language_model.score_texts(docs, F.coalesce(common.crc_mod("doc_id", 7) != 2, F.lit(True))).toPandas()
    tokens = {i: [*WORD.findall((t or "").translate(LOW)), None] for i, t, *_ in rows}
    counts = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in own)
    n, v = sum(counts.values()), len(counts)
    for r in out.itertuples():
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert r.score < 0


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(4)

    class Small:
        rank, counts, class_tokens = np.arange(10), np.ones(10), np.ones(language_model.TAIL_CLASSES)

    weights = {k: v.astype(np.float64) for k, v in language_model.first_weights(Small).items()}
    units = rng.integers(0, language_model.SOFT_WORDS + language_model.TAIL_CLASSES, (5, 3))

    def cost(grads=None):
        h, before, steps, states = np.zeros((3, language_model.HIDDEN)), np.full(3, language_model.SOFT_WORDS + language_model.TAIL_CLASSES), [], []
        for t in range(5):
            h, s = language_model.step(weights, before, h)
            steps.append(s)
            states.append(h)
            before = units[t]
        out, back = language_model.output_costs(weights, np.concatenate(states), units.ravel(), grads)
        if grads is not None:
            language_model.back_through(weights, steps, np.split(back, 5), grads)
        return -out.sum()

    grads = {k: np.zeros_like(v) for k, v in weights.items()}
    cost(grads)
    for k, w in weights.items():
        at = tuple(x[0] for x in np.nonzero(grads[k]))
        old = w[at]
        w[at] = old + 1e-5
        up = cost()
        w[at] = old - 1e-5
        assert grads[k][at] == pytest.approx((up - cost()) / 2e-5, rel=1e-4, abs=1e-6)
        w[at] = old


def test_every_token_of_every_text_teaches(monkeypatch):
    class Small:
        rank, counts, class_tokens = np.arange(10), np.ones(10), np.ones(language_model.TAIL_CLASSES)

    rng = np.random.default_rng(6)
    sizes = np.array([1, 2, 16, 17, 40, 112, 113, 300])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    units = rng.integers(0, language_model.SOFT_WORDS + language_model.TAIL_CLASSES, begins[-1])

    def gradients(unit, begins):
        weights = language_model.first_weights(Small)
        learner = language_model.Learner(weights, {k: np.ones_like(v) for k, v in weights.items()})
        learner.walk(unit, begins)
        return learner.pending + learner.learned, learner.grads

    monkeypatch.setattr(language_model, "UPDATE_TOKENS", 10**9)
    learned, together = gradients(units, begins)
    assert learned == begins[-1]
    apart = [gradients(units[a:b], np.array([0, b - a])) for a, b in zip(begins, begins[1:])]
    assert [n for n, _ in apart] == sizes.tolist()
    for k, g in together.items():  # the same wherever a text stands among others
        np.testing.assert_allclose(g, sum(own[k] for _, own in apart), rtol=1e-3, atol=1e-4)
    monkeypatch.setattr(language_model, "UPDATE_TOKENS", 64)
    monkeypatch.setattr(language_model, "SIDE_BY_SIDE", 3)
    assert gradients(units, begins)[0] == begins[-1]


def test_license_scans(spark):
    text = "Intro.\nReleased  under the MIT license!\nmore\nLicensed under CC BY-NC 4.0. And licensed under the Apache License, Version 2.0.\nlicense of nobody"
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (2, None, "en", "s", 0), (3, "no cue", "en", "s", 0), (4, "x" * 3000 + " Released under the MIT License. " + "y" * 3000, "en", "s", 0)], SCHEMA)
    got = license_scans.scan_licenses(docs).toPandas()
    assert sorted(zip(got["doc_id"], got["license"])) == [(1, "Apache-2.0"), (1, "CC-BY-NC-4.0"), (1, "MIT"), (4, "MIT")]
    assert all(text[r.begin : r.end].lower().endswith(("license", "4.0", "2.0")) for r in got[got["doc_id"] == 1].itertuples())


def test_license_notices_inside_prose():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    scanner = license_scans.Scanner(license_scans.TEMPLATES)
    for name, notice in license_scans.TEMPLATES.items():
        for n in (3, 30, 70, 400):
            before = prose(n) + ". "
            found = list(scanner.scan(before + notice + " " + prose(n)))
            assert [f[0] for f in found] == [name] and found[0][1] == len(before) and found[0][5] == 0, (name, n)
    # each place by its own words, also where one line holds templates that differ in a word
    both = [license_scans.TEMPLATES[k] for k in ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-4.0")]
    assert [f[0] for f in sorted(scanner.scan(" ".join(both)), key=lambda f: f[1])] == ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-4.0"]


def test_license_notices_over_line_breaks():
    scanner = license_scans.Scanner(license_scans.TEMPLATES)
    for name, notice in license_scans.TEMPLATES.items():
        for width, mark in ((72, ""), (80, "# "), (40, " * ")):
            text = "import os\n" + textwrap.fill(notice, width, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False) + "\n\ndef f():\n    return 1\n"
            found = list(scanner.scan(text))
            assert [f[0] for f in found] == [name] and found[0][5] == 0, (name, width)
            assert re.sub(r"\W+", "", text[found[0][1] : found[0][2]]) == re.sub(r"\W+", "", notice)
    # long runs of signs are no words, and cost no more than their length
    assert list(scanner.scan("-" * 300_000 + " license a" + "." * 300_000)) == []


def test_url_filters(spark):
    urls = ["http://WWW.Example.com/en/x?y", "https://a.example.com/en/", "https://b.net/es/1", "http://b.net", None, "nothing", "http://example.com/en", "ftp://x.net/fr/#a"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] + [(0, urls[0], "")], "page_id long, url string, html string")
    rules = spark.createDataFrame(url_filters.RULES, "rule string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, rules).collect() if r.page_id != 0)
    assert got == [
        (1, "a.example.com", "/en/", "example.com/en/", "block"), (2, "b.net", "/es/1", "net/es/", "block"), (3, "b.net", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "", "", None, "allow"), (6, "example.com", "/en", "com/", "allow"), (7, "x.net", "/fr/", "net/fr/", "block"),
    ]
    assert url_filters.judge_urls(pages, rules).where("page_id = 0 AND rule = 'www.example.com/en/' AND verdict = 'allow'").count() == 2


def test_quality_rules(spark):
    line = "one two three four five six seven eight nine ten"
    texts = [None, "", line, f"{line}\n{line}\n{line}", " ".join(f"w{i}#" for i in range(40)), f"\u000b{line} a b c d e f g h i j k {line}"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in quality_rules.judge_documents(docs, "doc_id").collect()}
    assert [got[i].n_words for i in range(6)] == [0, 0, 10, 30, 40, 31]
    assert [got[i].n_repeat_words for i in range(6)] == [0, 0, 0, 30, 0, 20]
    assert [got[i].n_dup_lines for i in range(6)] == [0, 0, 0, 2, 0, 0]
    assert got[4].n_symbols == 40 and not got[4].base_failed
    assert [got[i].base_failed for i in range(6)] == [True, True, True, True, False, True]


def test_failing_host_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 == 0 else "short", "en", "bad", 0) for i in range(200)] + [(1000 + i, good, "en", f"ok{i % 3}", 0) for i in range(300)]
    kept = quality_rules.keep_good(spark.createDataFrame(rows, SCHEMA))
    assert {r.source for r in kept.collect()} == {"ok0", "ok1", "ok2"} and kept.count() == 300


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}


def operators(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    return {
        "licenses": license_scans.scan_licenses(docs), "lm": language_model.score_texts(docs, F.lit(True)), "mix": mixing.mix(docs),
        "rules": quality_rules.judge_documents(docs, "doc_id"), "good": quality_rules.keep_good(docs), "bytes": suffix_dedup.drop_repeats(docs),
        "leaks": decontamination.find_leaks(docs, items), "clean": decontamination.drop_leaks(docs, items), "toxic": toxicity.toxicity(docs, labels),
        "links": jaccard_join.link_documents(docs), "one": jaccard_join.keep_one(docs), "phrases": repeats.gather(docs, phrase_dedup.phrase_spans(docs)),
    }


def test_empty_tables(spark, empty):
    assert {k: df.count() for k, df in operators(spark, empty).items() if df.count()} == {}


def test_clashing_columns_nulls_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b " * 300, "en", "s", 0), (2, "a b " * 300, "en", "s", 0), (None, "x y z", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("row", "n", "size", "node", "h", "kind", "spans", "packed", "bucket", "rate", "group", "_row")})
    counts = {k: df.count() for k, df in operators(spark, docs).items()}
    assert {k: counts[k] for k in ("lm", "mix", "rules", "bytes", "clean", "toxic", "links", "phrases")} == dict.fromkeys(("lm", "mix", "rules", "bytes", "clean", "toxic", "links", "phrases"), 6)


def test_batches_without_anchors(spark, tmp_path):
    """Partitions in which no text is as long as a stretch: short, null and empty ones, alone and beside long texts."""
    long = " ".join(f"word{i}" for i in range(50))
    short = [(i, "a b c d e", "en", "s", 9) for i in range(3)]
    cases = {"short": short, "null": [(i, None, "en", "s", 0) for i in range(2)], "both": [*short, (7, "", "en", "s", 0), (8, long, "en", "s", 1), (9, long, "en", "s", 1)]}
    for name, rows in cases.items():
        for parts in {1, len(rows)}:
            at = f"{tmp_path}/{name}-{parts}"
            spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{at}/documents.parquet")
            found = {query: [r.n_removed for r in query(spark, at).orderBy("doc_id").collect()] for query in (phrase_dedup.op10_phrase_dedup, suffix_dedup.op5_suffix_dedup)}
            none = [0] * len(short + [1])
            assert found[phrase_dedup.op10_phrase_dedup] == ([*none, 0, 50] if name == "both" else [0] * len(rows))
            assert found[suffix_dedup.op5_suffix_dedup] == ([*none, len(long), len(long)] if name == "both" else [0] * len(rows))


def test_most_frequent_of_equal_counts(spark):
    """Where all counts are equal some are taken all the same, about as many as may be; otherwise ties stay together."""
    equal = spark.createDataFrame([(f"w{i}", 7) for i in range(1000)], "word string, n long")
    taken = [r.word for r in common.most_frequent(equal, "n", 100).collect()]
    assert len(taken) == 100 and sorted(taken) == sorted(r.word for r in common.most_frequent(equal.repartition(5), "n", 100).collect())
    mixed = spark.createDataFrame([("a", 900), ("b", 50), ("c", 50), ("d", 3)], "word string, n long")
    assert {r.word for r in common.most_frequent(mixed, "n", 3).collect()} == {"a", "b", "c"} and {r.word for r in common.most_frequent(mixed, "n", 2).collect()} == {"a"}
    assert common.most_frequent(mixed.limit(0), "n", 2).count() == 0


CLASHES = ("row", "_row", "__row", "_spans", "spans", "node", "n", "size", "label", "block", "vector", "keys", "packed", "_kept", "bucket", "times", "_i", "h", "key", "host", "_host", "verdict", "ROW")


def test_stages_keep_clashing_columns(spark):
    good = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"thing{i}" for i in range(80))
    rows = [(None, None, None, None, None), (1, good, "en", "s", 0), (1, good, "en", "s", 0), (2, good + " more", "en", "s", 0), (3, "", "en", "s", 0), (4, other, "en", None, 1), (None, other + " z", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.concat(F.lit(c + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHES if c != "ROW"})
    assert "ROW" not in docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, common.keep(stage(spark, docs, "/root/testdata/sf0.001"))
        if i == 4:
            break
        assert docs.schema.names == before.schema.names, name
        for r in docs.collect():
            assert all(r[c] == f"{c}-{'?' if r.doc_id is None else r.doc_id}" for c in CLASHES if c != "ROW"), name
    assert sorted(r.doc_id or 0 for r in docs.collect()) in ([1, 4], [0, 1], [0, 1, 4])


def test_stages_take_empty_tables(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name


def test_pipeline_stages_chain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.keep(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.count() > 0
        if i < 4:
            assert docs.columns == columns


def decode_by_brute_force(word, costs):
    """All readings of a word, one by one."""
    letter = lambda c: ord(c) > 127 or c.isalpha()
    found = []

    def walk(i, text, cost):
        if i == len(word):
            found.append((cost, text))
            return
        c = word[i]
        for x in toxicity.DISGUISES.get(c, ""):
            walk(i + 1, text + x, cost + toxicity.COST_LETTER)
        if letter(c):
            walk(i + 1, text + c, cost)
            run = i
            while run < len(word) and word[run] == c:
                run += 1
            if run - i > 2:
                walk(run, text + c, cost + toxicity.COST_STRETCH)
                walk(run, text + c + c, cost + toxicity.COST_STRETCH)
        else:
            walk(i + 1, text + c, cost + (toxicity.COST_SIGN if c in toxicity.DISGUISES else 0))
            if c in toxicity.SEPARATORS:
                walk(i + 1, text, cost + toxicity.COST_GAP)

    walk(0, "", 0.0)

    def whole(cost, text):
        a = b = 0
        for ch in text:
            z = int(toxicity._CLASS[min(ord(ch), 255)])
            cost, a, b = cost + costs[a, b, z], b, z
        return cost + costs[a, b, 0]

    return min(whole(c, t) for c, t in found), whole


def test_decoding_finds_the_cheapest_reading():
    rng = random.Random(8)
    costs = np.random.default_rng(8).exponential(2.0, (64, 64, 64))
    for _ in range(60):
        word = "".join(rng.choice("ab04$!.e") * rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randint(1, 5)))[:8]
        best, whole = decode_by_brute_force(word, costs)
        least = min(cost for cost in (whole(extra, toxicity.decode(word, costs)) for extra in costs_of(word, toxicity.decode(word, costs))))
        assert least == pytest.approx(best), word
    # a run longer than LONG_RUN gives what a shorter one gives, and costs no more than its length
    flat = np.full((64, 64, 64), 0.7)
    assert toxicity.decode("m" + "o" * 40 + "ron", flat) == toxicity.decode("m" + "o" * 5 + "ron", flat)
    assert len(toxicity.decode("a" * 1_000_000, flat)) <= 2
    flat[1, 1, 1] = flat[0, 1, 1] = 0.0
    assert toxicity.decode("a" * 30, flat) == "a" * 30


def costs_of(word, reading):
    """The costs of the disguises of every way to read ``reading`` out of ``word``."""
    if not word:
        return [0.0] if not reading else []
    c, out = word[0], []
    for x in toxicity.DISGUISES.get(c, ""):
        if reading[:1] == x:
            out += [toxicity.COST_LETTER + e for e in costs_of(word[1:], reading[1:])]
    if ord(c) > 127 or c.isalpha():
        run = len(word) - len(word.lstrip(c))
        if reading[:1] == c:
            out += costs_of(word[1:], reading[1:])
        for k in (1, 2):
            if run > 2 and reading[:k] == c * k:
                out += [toxicity.COST_STRETCH + e for e in costs_of(word[run:], reading[k:])]
    else:
        if reading[:1] == c:
            out += [(toxicity.COST_SIGN if c in toxicity.DISGUISES else 0) + e for e in costs_of(word[1:], reading[1:])]
        if c in toxicity.SEPARATORS:
            out += [toxicity.COST_GAP + e for e in costs_of(word[1:], reading)]
    return out


def test_toxicity_of_odd_and_long_texts(spark):
    bad = [(i, f"you idiot {w} {v}", 1) for i, (w, v) in enumerate((w, v) for w in ("garden", "river", "music") for v in ("cloud", "story", "window"))]
    rows = bad + [(100 + i, f"{w} {v} table", 0) for i, (w, v) in enumerate((w, v) for w in ("garden", "river") for v in ("cloud", "story"))]
    odd = [(200, None), (201, ""), (202, "a" * 1_000_000), (203, "!" * 100_000), (204, "x " * 100_000 + "idiot"), (204, "x " * 100_000 + "idiot"), (None, "y")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows] + [(i, t, None, None, None) for i, t in odd], SCHEMA).withColumn("score", F.lit(5))
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    scores = [r.score for r in got]
    assert all(0 <= s <= 1 for s in scores) and {r.score for r in got if r.doc_id in (200, 201)} == {min(scores)}
    assert len({r.score for r in got if r.doc_id == 204}) == 1


def test_rows_that_teach_are_bounded(spark):
    labels = spark.range(9000).selectExpr("id AS doc_id", "1 AS quality", "int(id % 10 = 0) AS toxic")
    all_ = {r.doc_id: r.toxic for r in toxicity.taught_rows(labels).collect()}
    assert all_ == {i: int(i % 10 == 0) for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1}
    some = [r.toxic for r in toxicity.taught_rows(labels, 1000).collect()]
    assert sum(some) == sum(all_.values()) and 850 < len(some) - sum(some) < 1150


def test_most_frequent(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([5] * 10 + [70] * 4 + [12345, 12346, 999] + [1] * 50)], "h long, n long")
    kept = lambda most: sorted((r.n for r in common.most_frequent(counts, "n", most).collect()), reverse=True)
    assert kept(100) == sorted([5] * 10 + [70] * 4 + [12345, 12346, 999] + [1] * 50, reverse=True)
    assert kept(7) == kept(16) == [12346, 12345, 999, 70, 70, 70, 70] and kept(3) == [12346, 12345, 999] and len(kept(1)) == 1 and kept(1)[0] > 999


def test_url_filters_on_odd_pages(spark):
    rules = spark.createDataFrame(url_filters.RULES, "rule string, verdict string")
    schema = "page_id long, url string, host string, path string, rule string, verdict string"
    long_ = "http://" + "a." * 3000 + "example.com/en/" + "b/" * 10_000
    pages = spark.createDataFrame([(1, long_, "h", "p", "r", "v"), (1, long_, "h", "p", "r", "v"), (2, None, None, None, None, None), (None, "x://b.net/es//", "h", None, None, None), (3, "", "", "", "", "")], schema)
    got = sorted(((r.page_id or 0), r.rule or "", r.verdict) for r in url_filters.judge_urls(pages, rules).collect())
    assert got == [(0, "net/es/", "block"), (1, "example.com/en/", "block"), (1, "example.com/en/", "block"), (2, "", "allow"), (3, "", "allow")]
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filters.judge_urls(pages, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == 5


def test_repeated_rows_are_mixed_by_arithmetic(spark):
    rows = [(1, "a b c d e", "en", "x", 0)] * 3000 + [(i, "w " * 50, "en", "x", 0) for i in range(2, 40)] + [(100 + i, "v " * 400, "en", "y", 0) for i in range(90)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(4)).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all()
    for _, own in out.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 0.01 * own["target"].iloc[0] + 400
    copies = out[out["doc_id"] == 1]["copies"]
    assert copies.max() - copies.min() <= 1
