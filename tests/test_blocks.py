"""Work done block against block: TF-IDF pairs and temporal counts against plain versions."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters


def plain_pairs(texts, least):
    tf = {i: Counter(t.split(" ")) for i, t in texts}
    df = Counter(w for c in tf.values() for w in c)
    vectors = {}
    for i, c in tf.items():
        v = {w: n * (math.log((len(texts) + 1) / (df[w] + 1)) + 1) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {w: x / size for w, x in v.items()}
    out = {}
    for a in vectors:
        for b in vectors:
            dot = sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items())
            if a < b and round(dot, 6) >= least:
                out[a, b] = round(dot, 6)
    return out


@pytest.mark.parametrize("block", [clusters.BLOCK, 5])
def test_tfidf_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = random.Random(block)
    texts = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(1, 6)))) for i in range(80)] + [(200, "a b c"), (201, "c b a"), (202, "rare word")]
    df = spark.createDataFrame(texts, "id long, t string")
    for least in (0.5, 0.9):
        got = {(r.a, r.b): r.cosine for r in clusters.tfidf_pairs(df, F.split("t", " "), least).collect()}
        wanted = plain_pairs(texts, least)
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-5 for k in got)
    assert clusters.tfidf_pairs(df.limit(0), F.split("t", " "), 0.5).count() == 0


@pytest.mark.parametrize("block", [clusters.BLOCK, 2])
def test_temporal_counts(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = random.Random(1)
    t0 = datetime(2026, 1, 1)
    some = lambda: t0 + timedelta(minutes=rng.randrange(30000))
    items = spark.createDataFrame([(i, some()) for i in range(60)] + [(99, t0 + timedelta(days=400)), (98, None)], "item_id long, at timestamp")
    held = [(i, a, a + timedelta(minutes=rng.randrange(9000))) for i in range(50) for a in (some(),)]
    stored = spark.createDataFrame(held, "cluster_id long, first_at timestamp, last_at timestamp")
    pairs = clusters.temporal_candidates(items, stored, 3, 7).collect()
    wanted = {}
    for r in pairs:
        n, adjacent, far = wanted.get(r.item_id, (0, 0, 0.0))
        wanted[r.item_id] = (n + 1, adjacent + (r.distance_days > 0), max(far, r.distance_days))
    got = {r.item_id: (r.candidates, r.adjacent, round(r.furthest, 4)) for r in clusters.temporal_counts(items, stored, 3, 7).collect()}
    assert got == wanted and len(got) > 40


def test_near_ids_against_all_pairs(spark):
    rng = random.Random(9)

    def edited(x, n):
        for _ in range(n):
            i, kind = rng.randrange(len(x)), rng.randrange(3)
            x = x[:i] + (rng.choice("abc") if kind else "") + x[i + (kind < 2) :]
        return x

    open_ = {(g, "".join(rng.choice("abc") for _ in range(rng.randint(4, 24)))) for g in (1, 2) for _ in range(40)}
    wrong = {(g, edited(x, rng.randint(0, 4))) for g, x in open_} | {(1, ""), (1, "a"), (2, "abc")}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for edits in (1, 3):
        got = clusters.near_ids(spark.createDataFrame(sorted(wrong), "group int, answered string"), spark.createDataFrame(sorted(open_), "group int, id string"), edits)
        wanted = {(g, a, b) for g, a in wrong for h, b in open_ if g == h and len(b) > edits and distance(a, b) <= edits}
        assert {(r.group, r.answered, r.id) for r in got.collect()} == wanted and len(wanted) > 20


def test_temporal_counts_at_the_bounds(spark):
    """Items at and around every bound of a cluster, rounded ones included, each alone against the plain filter."""
    start, step, day = datetime(2024, 3, 1), 8_640_000, 86_400_000_000
    spans = [(0, 0), (0, 2 * day), (day, 8 * day + step // 2 - 1), (day, 8 * day + step // 2), (0, 9 * day)]
    stored = [(i, start + timedelta(microseconds=a), start + timedelta(microseconds=b)) for i, (a, b) in enumerate(spans)]
    edges = {e + m + d for a, b in spans for e in (a, b) for m in (-7 * day, -3 * day, 0, 3 * day, 7 * day) for d in (-step // 2 - 1, -step // 2, -1, 0, 1, step // 2 - 1, step // 2, step // 2 + 1)}
    items = [(i, start + timedelta(microseconds=e)) for i, e in enumerate(sorted(edges))]
    items, stored = spark.createDataFrame(items, "item_id long, at timestamp_ntz"), spark.createDataFrame(stored, "cluster_id long, first_at timestamp_ntz, last_at timestamp_ntz")
    wanted = {}
    for r in clusters.temporal_candidates(items, stored, 3, 7).collect():
        n, adjacent, far = wanted.get(r.item_id, (0, 0, 0.0))
        wanted[r.item_id] = n + 1, adjacent + (r.distance_days > 0), max(far, r.distance_days)
    got = {r.item_id: (r.candidates, r.adjacent, r.furthest) for r in clusters.temporal_counts(items, stored, 3, 7).collect()}
    assert got == wanted and len(got) > 100
