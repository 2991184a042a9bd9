"""Running sums by ranges against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, feeds, ranks


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_running_sums_over_ranges(spark, parts):
    rng = random.Random(int(parts))
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), rng.choice([None, 1, 2, rng.randrange(500)]), i, rng.choice([None, 0, 1, 5])) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v int, k int, w int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for group in ([], ["g"]):
            got = {r.k: r.before for r in ranks.running(df, [F.desc_nulls_last("v"), F.asc("k")], group, F.col("w")).collect()}
            wanted, sums = {}, {}
            for g, v, k, w in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
                g = g if group else 0
                wanted[k] = sums.get(g, 0)
                sums[g] = wanted[k] + (w or 0)
            assert got == wanted
        got = {r.k: (r.n, r.n_of) for r in feeds.numbered(df, "v", "k", "n", ["g"]).collect()}
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            assert [got[r[2]] for r in own] == [(i + 1, len(own)) for i in range(len(own))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranks.numbered(df.limit(0), [F.asc("v")]).count() == 0


def test_ranks_and_percentiles_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 7.0)], "g string, v double")
    assert {r.g: (r.p50, r.p99) for r in evaluation.nearest_rank(df, "g", "v", [0.5, 0.99]).collect()} == {"a": (2.0, 4.0), "b": (7.0, 7.0)}
    ties = spark.createDataFrame([(x,) for x in (5, 1, 5, 9)], "v int")
    assert {r.v: r.r for r in evaluation.average_ranks(ties, "v", "r").collect()} == {1: 1.0, 5: 2.5, 9: 4.0}
