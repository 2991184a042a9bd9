"""Nodes of the n-gram Jaccard join that can link with no other one of a block leave it before any round."""

import re

import numpy as np
import pytest
from tidemark.llm import jaccard_join

WORDS = [[f"w{i}x{j}" for j in range(50)] + [f"common{j}" for j in range(30)] for i in range(16)]
WORDS.append([*WORDS[3][:79], "other"])


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(WORDS)], "doc_id long, text string")


@pytest.mark.parametrize("few", [0, 64])
@pytest.mark.parametrize("n", [3, 60, 300])
def test_partners_are_those_of_all_pairs(monkeypatch, few, n):
    monkeypatch.setattr(jaccard_join, "FEW_POINTS", few)
    rng = np.random.default_rng(n)
    points = rng.poisson(3, (n, jaccard_join.DIMENSIONS)).astype(np.int32)
    points[n // 2 : n // 2 + n // 3] = points[: n // 3] + (rng.random((n // 3, jaccard_join.DIMENSIONS)) < 0.05)
    sizes, early = points.sum(axis=1).astype(np.int64), rng.random(n) < 0.7
    want = np.zeros(n, dtype=bool)
    for i in range(n):
        for j in range(n):
            small, large = (i, j) if sizes[i] <= sizes[j] else (j, i)
            fits = 185 * np.minimum(points[i], points[j]).sum() >= 85 * (sizes[i] + sizes[j])
            want[i] |= i != j and fits and early[small] and (early[large] or sizes[small] < sizes[large])
    assert (jaccard_join.with_partner(points, sizes, early) == want).all() and 0 < want.sum() < n or n == 3


def test_a_common_phrase_brings_no_text_to_the_rounds(spark, docs, monkeypatch):
    """16 texts share 27 of 77 shingles; only the near copy and its original, each with rows of its own, go on."""
    nodes = []
    whole = jaccard_join.parted

    def noting(members):
        nodes.append(members.select("node").distinct().count())
        return whole(members)

    monkeypatch.setattr(jaccard_join, "parted", noting)
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(docs).collect()}
    assert got == {i: 3 if i == 16 else i for i in range(17)} and nodes == [2]


def test_large_blocks_keep_their_nodes(spark, docs, monkeypatch):
    """Blocks over PART_NODES are not looked through, as no task sees them whole."""
    fresh = jaccard_join.describe(docs, texts=False).where("vector is not null")
    members = jaccard_join.keep(jaccard_join.blocks(fresh))
    points = fresh.select("node", "n", "vector")
    left = {n: 0 for n in (1, 20_000)}
    for most in left:
        monkeypatch.setattr(jaccard_join, "PART_NODES", most)
        left[most] = {(r.block, r.node, r.early) for r in jaccard_join.promising(members, points).collect()}
    assert left[1] == {(r.block, r.node, r.early) for r in members.collect()} and 0 < len(left[20_000]) < len(left[1])


def test_blocks_do_not_depend_on_tasks(spark, docs):
    """A block that several tasks make comes once, and a round needs no join by block and node."""
    fresh = jaccard_join.describe(docs, texts=False).where("vector is not null")
    held, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            found.append(sorted((r.block, r.node, r.early) for r in jaccard_join.blocks(fresh).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found[0] == found[1] and len({x[:2] for x in found[0]}) == len(found[0]) > 0
    members = spark.createDataFrame(found[0], "block long, node long, early boolean").selectExpr("*", "node as label")
    pairs = jaccard_join.round_candidates(members, fresh.select("node", "n", "vector"), 85, 0)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "simple")
    assert "Join" in plan and not re.search(r"Join \[(block|node)#\d+L?, (block|node)#", plan)
