"""Clustering batch by batch: how few links a dense batch makes, and items compared some at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events, incremental, tiles

from test_similarity import ITEMS, VECTORS, clustered, items, plain_cosines, plain_pass, read_back


def sorted_items(seed, n):
    return sorted(items(seed, n), key=lambda r: (r[2] is None, r[2] or 0, r[0]))


def test_links_of_a_dense_batch_are_few(spark, tmp_path, monkeypatch):
    """All items around one direction: as many links as connect them, not one for each pair."""
    rows = [(i, [1.0, 0.02 * (i % 5), 0.01 * (i % 7)], t, *rest) for i, _, t, *rest in sorted_items(9, 150)]
    seen, connected = [], events.connected
    monkeypatch.setattr(events, "connected", lambda links, *rest: seen.append(links.count()) or connected(links, *rest))
    for n in range(2):
        incremental.assign_batch(spark.createDataFrame(rows[n * 75 : (n + 1) * 75], ITEMS), str(tmp_path), n)
    assert read_back(spark, str(tmp_path)) == plain_pass(rows, incremental.Policy()) and len(seen) == 2 and max(seen) < 2 * 75


@pytest.mark.parametrize("within", [None, 30])
def test_forests_connect_what_all_links_do(spark, monkeypatch, within):
    monkeypatch.setattr(tiles, "LEAST", 40)
    v = clustered(11, 240, groups=30)
    marks = [None if i % 11 == 0 else i * 37 % 200 for i in range(240)]
    df = spark.createDataFrame([(i, x.tolist(), m) for i, (x, m) in enumerate(zip(v, marks))], f"{VECTORS}, m long").repartition(3)
    near = plain_cosines(v) >= 0.9
    gate = np.array([[within is None or a is None or b is None or abs(a - b) <= within for b in marks] for a in marks])

    def parts(links):
        label = list(range(240))
        for _ in range(240):
            before = list(label)
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label

    cases = [(tiles.links(df, 0.9, "id", "v", F.col("m"), within), np.triu(near & gate, 1))]
    sides = np.arange(240) < 90
    cases.append((tiles.links_between(df.where("id < 90"), df.where("id >= 90"), 0.9, "id", "v", F.col("m"), within), near & gate & np.outer(sides, ~sides)))
    for got, wanted in cases:
        pairs = [(r.a, r.b) for r in got.collect()]
        assert parts(pairs) == parts([(int(a), int(b)) for a, b in zip(*np.nonzero(wanted))]) and len(set(parts(pairs))) > 20


def test_items_some_at_once_give_one_pass(monkeypatch):
    """Blocks of seven items and of five clusters, in two batches of one component each."""
    monkeypatch.setattr(incremental, "TOGETHER", 7)
    monkeypatch.setattr(incremental, "COLUMNS", 5)
    for seed, policy in ((12, incremental.Policy(strong=0.85, gray_hours=48)), (13, incremental.Policy(k=1, strong=0.9, gray=0.5))):
        rows = sorted_items(seed, 400)
        run, known, got = incremental._sequential(policy), {}, {}
        schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("t", pa.int64()), ("author", pa.string()), ("category", pa.string()), ("entities", pa.list_(pa.string())), ("stored", pa.bool_()), ("n", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
        for part in (rows[:230], rows[230:]):
            batch = [(i, v, t, a, c, e, False, 1, t, t) for i, v, t, a, c, e in part] + [(r["cluster"], r["total"], None, r["author"], r["category"], r["entities"], True, r["n"], r["first"], r["last"]) for r in known.values()]
            out = run(pa.table([list(x) for x in zip(*reversed(batch))], schema=schema)).to_pylist()
            got |= {r["id"]: (r["cluster"], r["founded"], r["band"], None if r["cosine"] is None else round(r["cosine"], 6)) for r in out if r["kind"] == "item"}
            known |= {r["cluster"]: r for r in out if r["kind"] == "cluster"}
        state = {c: (r["n"], r["first"], r["last"], r["author"], r["category"], tuple(r["entities"])) for c, r in known.items()}
        assert (got, state) == plain_pass(rows, policy) and {x[2] for x in got.values()} == {None, "strong", "gray"}
