"""The cell index and clustering batch by batch, against plain passes over everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells, events, incremental

VECTORS = "id long, v array<float>"


def clustered(seed, n, width=8, groups=12, spread=0.35):
    """Rows around a few directions, exact copies among them."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, width))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    v = middles[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, width)) * rng.random((n, 1))
    v[n // 2 : n // 2 + n // 10] = v[0]
    return v.astype(np.float32)


def plain_cosines(v):
    u = v.astype(np.float64)
    return (u @ u.T) / np.outer(np.linalg.norm(u, axis=1), np.linalg.norm(u, axis=1))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 16)
    monkeypatch.setattr(cells, "QUERIES", 32)


@pytest.mark.parametrize("sample", [cells.SAMPLE, 20])
def test_top_k_is_exact(spark, small_blocks, sample):
    v = clustered(1, 300)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS).repartition(3)
    index = cells.build(df, cells=9, sample=sample)
    cos = np.round(plain_cosines(v), 9)
    for k, least in ((5, 0.2), (3, 0.95), (40, -1.0), (1, 0.9999)):
        got = {(r.q, r.s): r["rank"] for r in cells.top_k(df.where("id % 4 = 0"), index, k, least).collect()}
        wanted = {}
        for q in range(0, 300, 4):
            best = [s for s in np.lexsort((np.arange(300), -cos[q]))[:k] if cos[q, s] >= least - 1e-9]
            wanted |= {(q, s): i + 1 for i, s in enumerate(best)}
        assert got == wanted


def test_pairs_are_all_pairs_and_blocks_are_skipped(spark, small_blocks):
    v = clustered(2, 400)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS)
    index = cells.build(df, cells=20)
    cos = plain_cosines(v)
    for least in (0.4, 0.8, 0.97):
        got = {(r.a, r.b) for r in events.cosine_pairs(df.withColumnsRenamed({"id": "vec_id", "v": "embedding"}), least).collect()}
        assert got == {(a, b) for a, b in zip(*np.nonzero(np.triu(cos >= least, 1)))}
    wanted = cells._usable(df, "id", "v").withColumn("floor", F.lit(0.9))
    met = cells._chunks(wanted, index, cells._within_reach).agg(F.sum(F.size("ids"))).first()[0]
    assert met < 0.5 * 400 * index.rings[:, 4].sum()  # of all queries times all blocks


def test_recall_of_probes_on_clustered_vectors(spark):
    v = clustered(3, 2000, width=16, groups=40)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS)
    index = cells.build(df, cells=40)
    queries = df.where("id % 20 = 0")
    exact = {(r.q, r.s) for r in cells.top_k(queries, index, 5, 0.2).collect()}
    some = {(r.q, r.s) for r in cells.top_k(queries, index, 5, 0.2, probes=4).collect()}
    assert len(some & exact) >= 0.9 * len(exact)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [2.0, 0.0]), (4, [0.0, -1.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("cell", F.lit(1)).withColumn("floor", F.lit(2))
    index = cells.build(df)
    assert sorted((r.q, r.s) for r in cells.pairs(df.where("id = 1"), index, 0.5).collect()) == [(1, 1), (1, 4)]
    empty = cells.build(df.limit(0))
    assert cells.pairs(df, empty, 0.5).count() == 0 and cells.top_k(df.where("id = 1"), empty, 3, 0.1).count() == 0
    assert cells.pairs(df.limit(0), index, 0.5).count() == 0
    with pytest.raises(Exception, match="vectors of several sizes"):
        cells.build(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], VECTORS)).blocks.count()


# clustering batch by batch

ITEMS = "id long, v array<double>, t long, author string, category string, entities array<string>"


def items(seed, n, width=6):
    rng = random.Random(seed)
    v = clustered(seed, n, width, groups=8, spread=0.5)
    day = incremental.DAY
    return [
        (i, v[i].astype(float).tolist(), None if rng.random() < 0.03 else int(rng.random() * 20 * day), rng.choice(["ann", "bob", None]), rng.choice(["x", "y"]), rng.sample(["e1", "e2", "e3", "e4"], rng.randint(1, 4)))
        for i in range(n)
    ]


def plain_pass(rows, policy):
    """One pass over all items with every cluster looked at."""
    work = incremental.Pass(policy, len(rows[0][1]))
    out = {}
    for i, v, t, author, category, entities in rows:
        at, founded, band, cosine = work.place({"id": i, "t": t, "author": author, "category": category, "entities": set(entities)}, cells.unit(np.array(v)))
        out[i] = (work.clusters[at]["cluster"], founded, band, None if cosine is None else round(cosine, 6))
    return out, {c["cluster"]: (c["n"], c["first"], c["last"], c["author"], c["category"], tuple(sorted(c["entities"]))) for c in work.clusters}


def read_back(spark, folder):
    placed = {r.id: (r.cluster, r.founded, r.band, None if r.cosine is None else round(r.cosine, 6)) for r in incremental.assignments(spark, folder).collect()}
    return placed, {r.cluster: (r.n, r.first, r.last, r.author, r.category, tuple(r.entities)) for r in incremental.clusters(spark, folder).collect()}


@pytest.mark.parametrize(("seed", "batches"), [(5, 1), (6, 3)])
def test_batches_give_one_pass(spark, tmp_path, seed, batches):
    policy = incremental.Policy(strong=0.85, gray_hours=48)
    rows = sorted(items(seed, 160), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    wanted = plain_pass(rows, policy)
    assert {x[2] for x in wanted[0].values()} == {None, "strong", "gray"}
    size = -(-len(rows) // batches)
    for n in range(batches):
        incremental.assign_batch(spark.createDataFrame(rows[n * size : (n + 1) * size], ITEMS), str(tmp_path), n, policy)
    assert read_back(spark, str(tmp_path)) == wanted


def test_a_batch_cut_off_is_run_again(spark, tmp_path):
    """Clusters written, items not: the batch is not finished, and running it once more gives the same state. Items that
    come a second time are left alone."""
    rows = sorted(items(7, 60), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    folder = str(tmp_path)
    one, two = spark.createDataFrame(rows[:30], ITEMS), spark.createDataFrame(rows[20:], ITEMS)
    incremental.assign_batch(one, folder, 0)
    incremental.assign_batch(two, folder, 1)
    wanted = read_back(spark, folder)
    (tmp_path / "assigned" / "batch=1" / "_SUCCESS").unlink()
    assert incremental.finished(spark, folder) == 1
    incremental.assign_batch(two, folder, 1)
    assert read_back(spark, folder) == wanted == plain_pass(rows, incremental.Policy())


def test_stream_goes_on_where_it_was(spark, tmp_path):
    rows = sorted(items(8, 60), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    for n in range(2):
        spark.createDataFrame(rows[n * 30 : (n + 1) * 30], ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ITEMS).parquet(str(tmp_path / "in"))
        incremental.cluster_stream(stream, str(tmp_path / "state"))
    assert incremental.finished(spark, str(tmp_path / "state")) == 2
    assert read_back(spark, str(tmp_path / "state")) == plain_pass(rows, incremental.Policy())


def test_query_gives_one_pass(spark):
    """incremental_clusters in three batches, and one plain pass over the same items."""
    from tidemark.plans import similarity

    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.id, [float(x) for x in r.v], r.t, r.author, r.category, r.entities) for r in similarity.timed_items(spark, sf_dir).orderBy("t", "id").collect()]
    got = {r.id: (r.cluster, r.founded, r.band, r.cosine) for r in similarity.incremental_clusters(spark, sf_dir).collect()}
    assert got == plain_pass(rows, incremental.Policy())[0]
    assert sum(not x[1] for x in got.values()) > 10
