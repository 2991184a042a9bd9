"""Ids at most so many edits apart, against all pairs, and how many rows meet on the way there."""

import hashlib
import random

import pytest

from tidemark.operators import clusters


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j + 1] + 1, now[j] + 1, before[j] + (x != y)))
        before = now
    return before[-1]


def edited(rng, text, most, signs):
    text = list(text)
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(text) + 1)
        text[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(signs)])
    return "".join(text)


@pytest.mark.parametrize("edits", [0, 1, 2, 3, 4, 5])
def test_near_ids_against_all_pairs(spark, edits):
    rng = random.Random(edits)
    signs = "ab1é😀"
    ids = {(rng.choice("xy"), "k-" * rng.randint(0, 2) + "".join(rng.choice(signs) for _ in range(rng.randint(1, 12)))) for _ in range(90)}
    tried = {(g, edited(rng, i, edits + 1, signs)) for g, i in ids} | {("x", ""), ("y", "a")}
    wrong = spark.createDataFrame([*tried, *list(tried)[:3], (None, "ab1ab1"), ("x", None)], "group string, answered string")
    open_ = spark.createDataFrame([*ids, *list(ids)[:3], (None, "ab1ab1"), ("x", None)], "group string, id string")
    got = [(r.group, r.answered, r.id) for r in clusters.near_ids(wrong, open_, edits).collect()]
    wanted = {(g, a, i) for g, a in tried for h, i in ids if g == h and len(i) > edits and distance(a, i) <= edits}
    assert len(got) == len(set(got)) and set(got) == wanted and wanted


def test_ids_that_begin_alike_do_not_all_meet(spark):
    """Every other id answered with a slip at its end: all begin with the same letters, as ids of one kind do."""
    for n in (400, 3200):
        ids = [f"item-{hashlib.md5(str(i).encode()).hexdigest()[:23]}" for i in range(n)]
        open_ = spark.createDataFrame([("g", x) for x in ids], "group string, id string")
        wrong = spark.createDataFrame([("g", x[:-6] + x[-5:] + "zz") for x in ids[::2]], "group string, answered string")
        met = [r.id for r in clusters.meeting_ids(wrong, open_, 3).collect()]
        assert set(met) >= set(ids[::2]) and len(met) < 2 * n


def test_no_table_goes_through_the_driver(spark):
    """Only the places of cuts, a row for each few lengths, are broadcast, however small the tables seem to be."""
    ids = [f"item-{hashlib.md5(str(i).encode()).hexdigest()[:9]}" for i in range(50)]
    open_ = spark.createDataFrame([("g", x) for x in ids], "group string, id string")
    answered = spark.createDataFrame([("g", x[:-1] if i % 2 else x) for i, x in enumerate(ids)], "group string, id string")
    # as small as tables are guessed to be whose ids are made of short columns
    found = clusters.repaired_ids(answered.limit(60), open_.limit(60), 1, 0.85)
    assert sorted(r.id for r in found.collect()) == sorted(ids)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "HashJoin" in line or "NestedLoopJoin" in line]
    assert joins and all("least" in line and "BroadcastHashJoin" in line for line in joins)
