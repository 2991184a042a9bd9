"""Page sequences across publishes, stale dependents, cursors."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import snapshots
from tidemark.sources.versions import VersionedTables

T0 = datetime(2026, 1, 1)
DRAFTS = "event_id long, title string, summary string, visible boolean"


def made(spark, folder, n=90):
    rng = random.Random(3)
    events = [(i, rng.choice(["a", "b", None]), f"t{i}", None, rng.random() < 0.8, rng.choice([None, T0 + timedelta(hours=rng.randrange(40))]), 1) for i in range(n)] + [(None, "a", "none", None, True, T0, 1)]
    dependents = [(100 * i + k, i, [None, 1, 2][k], False) for i in range(n) for k in range(3)]
    feed = snapshots.Feed(VersionedTables(spark, folder))
    feed.begin(spark.createDataFrame(events, snapshots.EVENT_SCHEMA), spark.createDataFrame(dependents, snapshots.DEPENDENT_SCHEMA))
    return feed, events[:-1]


def order(events, scope):
    shown = [e for e in events if e[4] and scope in ("_all", e[1])]
    return [e[0] for e in sorted(shown, key=lambda e: (e[5] is not None, e[5] or T0, e[0]), reverse=True)]


def all_pages(feed, scope, n, between=None):
    ids, cursor, first = [], None, True
    while first or cursor:
        rows, cursor = feed.page(scope, n, cursor)
        ids += [r.event_id for r in rows.orderBy("rank").collect()]
        if first and between:
            between()
        first = False
    return ids


def test_pages_across_a_publish(spark, tmp_path):
    feed, events = made(spark, str(tmp_path))
    drafts = [(i, f"new{i}", None, [None, True, False][i % 3]) for i in range(0, 90, 2)] + [(1, None, None, None), (12345, "not there", None, True), (None, "x", None, None)]
    before = order(events, "_all")
    assert all_pages(feed, "_all", 17, lambda: feed.publish(spark.createDataFrame(drafts, DRAFTS))) == before
    for i, title, _, visible in drafts[:45]:
        e = events[i]
        events[i] = (e[0], e[1], title, e[3], e[4] if visible is None else visible, e[5], 2)
    for scope in ("_all", "a", "b"):
        assert all_pages(feed, scope, 11) == order(events, scope)
    live = {r.event_id: (r.title, r.live_version) for r in feed.events().collect()}
    assert live == {e[0]: (e[2], e[6]) for e in events}
    stale = {r.dependent_id for r in feed.dependents().where("is_stale").collect()}
    assert stale == {100 * i + k for i in range(0, 90, 2) for k in (0, 1)}


def test_one_draft_touches_one_bucket(spark, tmp_path):
    feed, events = made(spark, str(tmp_path))
    one = feed.tables.current()
    two = feed.publish(spark.createDataFrame([(5, "new", None, None)], DRAFTS))
    assert sum(two.tables["events"][b] != p for b, p in one.tables["events"].items()) == 1
    assert sum(two.tables["dependents"][b] != p for b, p in one.tables["dependents"].items()) == 1
    assert sum(two.tables["feed"].get(b) != p for b, p in one.tables["feed"].items()) <= 2
    assert all(os.path.isdir(p.removeprefix("file:")) for t in one.tables.values() for p in t.values())


def test_cursors(spark, tmp_path):
    for bad in (None, "", "{", "[]", "7", '{"version": 1}', '{"version": 0, "scope": "a", "rank_after": 1}', '{"version": 1, "scope": " ", "rank_after": 1}', '{"version": 1, "scope": "a", "rank_after": -1}', '{"version": 1, "scope": "a", "rank_after": "x"}'):
        assert snapshots.cursor_of(bad) is None
    ids = list(range(300)) + [1, 2]
    at = snapshots.cursor_of(snapshots.Cursor(1, "a", 3, tuple(ids)).text())
    assert (at.version, at.scope, at.rank_after, at.exclude_ids) == (1, "a", 3, tuple(range(200)))
    feed, events = made(spark, str(tmp_path), 20)
    wanted = order(events, "_all")
    rows, cursor = feed.page("_all", 3, None, exclude=(wanted[1], wanted[4]))
    assert [r.event_id for r in rows.orderBy("rank").collect()] == [wanted[0], wanted[2], wanted[3]]
    rows, _ = feed.page("_all", 3, cursor)
    assert [r.event_id for r in rows.orderBy("rank").collect()] == wanted[5:8]
    rows, _ = feed.page("a", 3, cursor)  # of another scope
    assert [r.event_id for r in rows.orderBy("rank").collect()] == order(events, "a")[:3]
    assert feed.page("no such scope", 3)[0].count() == 0
    assert feed.events().where(F.col("event_id").isNull()).count() == 0


def test_states_and_pages_with_totals(spark):
    from tidemark.operators import feeds

    rows = [(1, None, None, None, None), (2, T0, None, None, ["Key", None]), (3, None, T0, None, None), (4, T0, T0, T0, ["other"]), (5, None, None, T0, [])]
    df = spark.createDataFrame(rows, "id int, clicked_at timestamp, starred_at timestamp, hidden_at timestamp, words array<string>").withColumn("t", F.lit("Text"))
    ids = lambda c: sorted(r.id for r in df.where(c).collect())
    assert ids(feeds.in_state(unread=True)) == [1, 3] and ids(feeds.in_state(starred=True)) == [3, 4] and ids(feeds.in_state(clicked=True)) == [2, 4]
    assert ids(feeds.in_state(unread=True, starred=True)) == [3] and ids(feeds.in_state()) == [1, 2, 3, 4, 5]
    assert ids(feeds.holds_any("KEY", "t", "words")) == [2] and ids(feeds.holds_any("eX", "t", "words")) == [1, 2, 3, 4, 5] and ids(feeds.holds_any("", "words")) == [1, 2, 3, 4, 5]
    for limit, offset, wanted in ((2, 0, [(1, 5, True, 2), (2, 5, True, 2)]), (2, 4, [(5, 5, False, None)]), (0, 3, [(4, 5, False, None), (5, 5, False, None)]), (2, 9, [])):
        got = feeds.page_of(df.select("id"), [F.col("id")], limit, offset).orderBy("id").collect()
        assert [tuple(r) for r in got] == wanted
