"""Tiles of vectors against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells, events, tiles

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture
def small(monkeypatch):
    for name, value in (("MOST", 40), ("LEAST", 30), ("ROWS", 16), ("COLUMNS", 24), ("MANY", 50)):
        monkeypatch.setattr(tiles, name, value)


def vectors(spark, seed=1, n=200):
    """Rows with copies, near copies, opposite and odd ones; the usable ones as unit vectors, with their labels."""
    rng = np.random.default_rng(seed)
    v = np.repeat(rng.normal(size=(n // 4, 6)), 4, axis=0) + np.repeat([[0.0], [0.0], [0.2], [0.6]], n // 4, axis=1).T.reshape(-1, 1) * rng.normal(size=(n, 6))
    v = v.astype(np.float32)
    label = [None if i % 11 == 0 else i % 3 for i in range(n)]
    rows = [(i, x.tolist(), k) for i, (x, k) in enumerate(zip(v, label))]
    odd = [(n, [0.0] * 6, 1), (n + 1, None, 1), (None, [1.0] * 6, 1), (n + 2, [1.0, 2.0], 1), (0, v[0].tolist(), None)]
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(3), u @ u.T, label


def test_all_pairs_once(spark, small):
    df, cos, _ = vectors(spark)
    for least in (0.5, 0.95):
        got = events.cosine_pairs(df, least).where("a <> 0").collect()
        wanted = {(a, b) for a, b in zip(*np.nonzero(np.triu(cos >= least, 1))) if a}
        assert len(got) == len(wanted) and {(r.a, r.b) for r in got} == wanted
        assert all(abs(r.cosine - cos[r.a, r.b]) < 1e-12 for r in got)


def test_links_connect_what_pairs_connect(spark, small):
    df, cos, _ = vectors(spark, 2)
    df = df.where("vec_id IS NOT NULL")
    links = tiles.links(df, 0.6, "vec_id", "embedding")
    nodes = df.select("vec_id").distinct()
    wanted = {(r.id, r.label) for r in events.connected(events.cosine_pairs(df, 0.6), nodes, "vec_id").collect()}
    assert {(r.id, r.label) for r in events.connected(links, nodes, "vec_id").collect()} == wanted
    # a large component is no square of links
    one = spark.createDataFrame([(i, [1.0, i / 1e6], 0) for i in range(300)], SCHEMA)
    assert tiles.links(one, 0.6, "vec_id", "embedding").count() <= 300 * (10 + 1)


def test_counts_of_bins(spark, small):
    df, cos, label = vectors(spark, 3)
    df = df.where("vec_id <> 0")
    bounds = [0.2, 0.5, 0.8, 1.0]
    whole, alike, by = {}, {}, {}
    for a in range(1, 200):
        for b in range(a + 1, 200):
            c = 1.0 if cos[a, b] > 1 - 1e-12 else cos[a, b]
            if c >= bounds[0]:
                at = sum(c >= x for x in bounds) - 1
                whole[at] = whole.get(at, 0) + 1
                if label[a] is not None and label[a] == label[b]:
                    alike[at] = alike.get(at, 0) + 1
                    by[label[a], at] = by.get((label[a], at), 0) + 1
    got = tiles.counts(df, bounds, "vec_id", "embedding", mark="label").collect()
    assert {r.bin: r.n for r in got} == whole and {r.bin: r.same for r in got if r.same} == alike
    assert {(r.mark, r.bin): r.n for r in tiles.counts(df, bounds, "vec_id", "embedding", group="label").collect()} == by
    assert 3 in whole  # equal vectors have a cosine of 1 and not a little less


@pytest.mark.parametrize("k, least", [(3, 0.2), (7, -1.0), (40, 0.9)])
def test_best_of_each_query(spark, small, k, least):
    df, cos, _ = vectors(spark, 4)
    df = df.where("vec_id <> 0 AND vec_id < 200")
    cos = np.round(np.where(cos > 1 - 1e-12, 1.0, cos), 9)
    got = {(r.q, r.s): r["rank"] for r in tiles.top_k(df.where("vec_id % 5 = 0"), df, k, least, "vec_id", "embedding").collect()}
    wanted = {}
    for q in range(5, 200, 5):
        best = [s for s in np.lexsort((np.arange(200), -cos[q])) if s and cos[q, s] >= least][:k]
        wanted |= {(q, s): i + 1 for i, s in enumerate(best)}
    assert got == wanted


def test_nothing_to_meet(spark):
    df, _, _ = vectors(spark)
    for some in (df.limit(0), df.where("vec_id = 200"), df.where("vec_id = 7")):
        assert not events.cosine_pairs(some, 0.1).count() and not tiles.links(some, 0.1, "vec_id", "embedding").count()
        assert not tiles.counts(some, [0.1], "vec_id", "embedding").count()
    assert not tiles.top_k(df, df.limit(0), 3, 0.1, "vec_id", "embedding").count()


def test_cells_send_no_side_through_the_driver(spark):
    """Few queries go to many blocks, so what they are together is not to be broadcast by what they were before."""
    v = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5)]) for i in range(400)], "id long, v array<double>")
    index = cells.build(v, cells=9)
    wanted = cells._usable(v.where("id % 20 = 0"), "id", "v").withColumn("floor", F.lit(0.2))
    plan = cells._hits(cells._chunks(wanted, index, cells._within_reach), index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
