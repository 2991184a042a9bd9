"""The read model from deltas against the roll-up from scratch, its shards, versions and untouched files."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import readmodel
from tidemark.sources.versions import VersionedTables

CHANGES = readmodel.CARD_SCHEMA + ", deleted boolean, changed_at timestamp"
T0 = datetime(2026, 7, 9, 16, 24)


def change(rng, item, at):
    pick = lambda *xs: rng.choice(xs)
    subs = pick(None, [], ["s1"], ["s1", "s2"], ["s2", "s2"])
    return (item, pick("x", "y", None), pick("a", "b", None), pick("c1", "c2", None), subs, pick(None, T0 + timedelta(minutes=rng.randrange(9999))), rng.random() < 0.25, at)


def rows_of(df):
    return sorted(map(repr, df.select(*readmodel.KEY, "total_count", "max_rank_at").collect()))


def last_cards(rows):
    last = {}
    for r in sorted(rows, key=lambda r: r[7]):
        last[r[0]] = r
    return [r[:6] for r in last.values() if not r[6]]


def test_any_series_of_deltas_gives_the_whole_roll_up(spark, tmp_path):
    rng = random.Random(3)
    model = readmodel.ReadModel(VersionedTables(spark, str(tmp_path)))
    seen = []
    for n in range(4):
        items = rng.sample(range(120), (60, 3, 25, 1)[n])
        delta = [change(rng, i, T0 + timedelta(hours=n)) for i in items]
        seen += delta
        model.refresh(spark.createDataFrame(delta, CHANGES))
        wanted = readmodel.rolled_up(spark.createDataFrame(last_cards(seen), readmodel.CARD_SCHEMA))
        assert rows_of(model.scopes()) == rows_of(wanted)


def test_untouched_buckets_keep_their_files_and_old_versions_their_rows(spark, tmp_path):
    rng = random.Random(4)
    tables = VersionedTables(spark, str(tmp_path))
    model = readmodel.ReadModel(tables)
    one = model.refresh(spark.createDataFrame([change(rng, i, T0)[:6] + (False, T0) for i in range(200)], CHANGES))
    before = rows_of(model.scopes(one))
    two = model.refresh(spark.createDataFrame([(7, "x", "a", "c1", ["s9"], T0, False, T0)], CHANGES))
    for table, most in (("cards", 1), ("parts", 1), ("scopes", 12)):
        moved = [b for b in one.tables[table] if two.tables[table].get(b) != one.tables[table][b]]
        assert 0 < len(moved) <= most
    assert rows_of(model.scopes(one)) == before != rows_of(model.scopes(two))
    assert tables.current() == two
    # the last member of a scope goes, and the scope with it
    three = model.refresh(spark.createDataFrame([(7, None, None, None, None, None, True, T0)], CHANGES))
    assert model.scopes(two).where(F.col("value").endswith("s9")).count() == 1 and model.scopes(three).where(F.col("value").endswith("s9")).count() == 0
    with pytest.raises(RuntimeError, match="another writer"):
        tables.commit(one, {}, {})


def test_shards_end_at_now_and_go_on_behind_the_watermark(spark, tmp_path):
    assert readmodel.shard_end(T0, T0 + timedelta(hours=48), timedelta(hours=6)) == T0 + timedelta(hours=6)
    assert readmodel.shard_end(T0 + timedelta(hours=45), T0 + timedelta(hours=48), timedelta(hours=6)) == T0 + timedelta(hours=48)
    rng = random.Random(5)
    rows = [change(rng, rng.randrange(40), T0 + timedelta(minutes=7 * i)) for i in range(120)] + [(None, *change(rng, 1, T0)[1:]), change(rng, 2, None)]
    changes, now = spark.createDataFrame(rows, CHANGES), T0 + timedelta(minutes=7 * 119)
    model = readmodel.ReadModel(VersionedTables(spark, str(tmp_path)))
    steps = model.catch_up(changes, T0 - timedelta(minutes=1), now, timedelta(hours=6))
    _, reached = next(steps)
    assert not reached
    steps.close()  # the run ends here; another one goes on
    rest = list(readmodel.ReadModel(VersionedTables(spark, str(tmp_path))).catch_up(changes, T0, now, timedelta(hours=6)))
    assert [r for _, r in rest] == [False, True]
    wanted = readmodel.rolled_up(spark.createDataFrame(last_cards(rows[:120]), readmodel.CARD_SCHEMA))
    assert rows_of(model.scopes()) == rows_of(wanted)
    assert list(model.catch_up(changes, T0, now, timedelta(hours=6))) == []


def test_a_run_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    tables = VersionedTables(spark, str(tmp_path))
    model = readmodel.ReadModel(tables)
    one = model.refresh(spark.createDataFrame([change(rng, i, T0) for i in range(30)], CHANGES))
    before = rows_of(model.scopes())

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTables, "commit", dies)
        with pytest.raises(OSError):
            model.refresh(spark.createDataFrame([change(rng, i, T0) for i in range(50)], CHANGES))
    assert tables.current() == one and rows_of(model.scopes()) == before
    assert len(os.listdir(tmp_path / "versions")) == len([n for n in os.listdir(tmp_path / "versions") if not n.endswith(".tmp")])
