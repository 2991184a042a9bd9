"""Streams over several files and batches, late rows, restarts."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events as a folder of seven files, in order of time."""
    path = str(tmp_path_factory.mktemp("tables"))
    for first in range(0, 1000, 150):  # a fold over failures in a row takes files in the order in which they came
        spark.read.parquet(EVENTS).where(F.col("event_id").between(first, first + 149)).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["stream_dedup", "stream_tumbling", "stream_newest_per_key", "stream_status_fold", "stream_source_health"])
def test_streams_over_several_batches(spark, folder, name, monkeypatch):
    source = jobs.source
    monkeypatch.setattr(jobs, "source", lambda *a: source(*a, files_per_trigger=2))
    got = catalog.queries()[name](spark, folder)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{EVENTS}')")
    want = con.execute(catalog.oracles()[name])
    names = [d[0] for d in want.description]
    plain = lambda v: round(v, 4) if isinstance(v, float) else str(v)
    assert sorted(repr([plain(v) for v in r]) for r in got.select(*columns).collect()) == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in want.fetchall())


def rows_of(spark, path, number, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")


def test_late_rows_and_restart(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    os.makedirs(path)
    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    read = lambda: {
        (r.day.day, r.event_type): r.n
        for r in jobs.run_once(jobs.daily_counts(jobs.source(spark, path, "events", 1)), "update", ["day", "event_type"], state).select(F.to_date("day").alias("day"), "event_type", "n").collect()
    }
    rows_of(spark, path, 0, [(1, day(2), 1, "view", 1.0, ""), (2, day(9), 1, "view", 1.0, "")])
    assert read() == {(2, "view"): 1, (9, "view"): 1}
    # the watermark stands at the 6th: a row of the 8th still counts, one of the 2nd comes too late
    rows_of(spark, path, 1, [(3, day(8), 1, "view", 1.0, ""), (4, day(2), 1, "view", 1.0, ""), (5, day(9), 2, "click", 1.0, "")])
    assert read() == {(2, "view"): 1, (8, "view"): 1, (9, "view"): 1, (9, "click"): 1}
    assert read() == {(2, "view"): 1, (8, "view"): 1, (9, "view"): 1, (9, "click"): 1}
