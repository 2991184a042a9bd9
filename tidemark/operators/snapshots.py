"""A feed of events in versions: publishing drafts, dependents that become stale, and cursors that stay with their version.

Three tables are kept in versions: ``events`` in buckets by event, their ``dependents`` (what readers made of an event) in
the same buckets, and ``feed``, the shown events of each scope with their ranks, in buckets by scope. Publishing writes the
buckets of the published events and of their scopes again and commits all of it as one version, so a reader sees either all
of a publish or nothing. A cursor names its version, so the pages behind it are the rest of the feed that it began with,
whatever has been published since: no row comes twice and none is lost.

Null categories are only in the scope of all events. Events without an id are left out; ids must differ.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import discard, keep
from ..sources.versions import Version, VersionedTables, bucket_of
from . import ranks

EVENT_BUCKETS, SCOPE_BUCKETS = 16, 16
ALL = "_all"
#: Most ids that a cursor leaves out, as a reader has seen them elsewhere.
MOST_EXCLUDED = 200
EVENT_SCHEMA = "event_id long, category string, title string, summary string, visible boolean, last_at timestamp, live_version long"
DEPENDENT_SCHEMA = "dependent_id long, event_id long, event_version long, is_stale boolean"
FEED_SCHEMA = "scope string, rank long, event_id long"


@dataclass(frozen=True)
class Cursor:
    """Where a page sequence stands: behind ``rank_after`` of a scope in a version."""

    version: int
    scope: str
    rank_after: int
    exclude_ids: tuple[int, ...] = ()

    def text(self) -> str:
        return json.dumps({"version": self.version, "scope": self.scope, "rank_after": self.rank_after, "exclude_ids": list(self.exclude_ids)})


def cursor_of(text: str | None) -> Cursor | None:
    """The cursor of a text; None where it is none. Excluded ids count once each and MOST_EXCLUDED at the most."""
    try:
        data = json.loads(text or "")
        version, scope, after = int(data["version"]), str(data["scope"] or "").strip(), int(data["rank_after"])
        ids = dict.fromkeys(int(x) for x in data.get("exclude_ids") or [])
    except (ValueError, TypeError, KeyError, AttributeError):
        return None
    return Cursor(version, scope, after, tuple(ids)[:MOST_EXCLUDED]) if version > 0 and scope and after >= 0 else None


class Feed:
    def __init__(self, tables: VersionedTables) -> None:
        self.tables = tables

    def events(self, version: Version | None = None) -> DataFrame:
        return self.tables.read(version or self.tables.current(), "events", EVENT_SCHEMA)

    def dependents(self, version: Version | None = None) -> DataFrame:
        return self.tables.read(version or self.tables.current(), "dependents", DEPENDENT_SCHEMA)

    def _feed(self, before: Version, events: dict[str, str], scopes: DataFrame) -> tuple[list[int], dict[str, str]]:
        """Ranks the given scopes (column scope) anew from the events in folders ``events``; gives their buckets and folders."""
        buckets = sorted(r.b for r in scopes.select(bucket_of("scope", buckets=SCOPE_BUCKETS).alias("b")).distinct().collect())
        shown = self.tables.read(Version(0, {"events": events}), "events", EVENT_SCHEMA).where("visible")
        each = shown.select("event_id", "last_at", F.explode(F.array_compact(F.array(F.lit(ALL), "category"))).alias("scope")).join(scopes, "scope", "left_semi")
        ranked = ranks.numbered(each, [F.desc_nulls_last("last_at"), F.desc("event_id")], ["scope"], "rank").select("scope", "rank", "event_id")
        same = self.tables.read(before, "feed", FEED_SCHEMA, buckets).join(scopes, "scope", "left_anti")
        rows = same.select("scope", "rank", "event_id").unionByName(ranked).withColumn("bucket", bucket_of("scope", buckets=SCOPE_BUCKETS))
        return buckets, self.tables.write(rows, "bucket", buckets)

    def begin(self, events: DataFrame, dependents: DataFrame) -> Version:
        """The first version: events as they are, with their dependents (EVENT_SCHEMA, DEPENDENT_SCHEMA)."""
        mark, every = bucket_of("event_id", buckets=EVENT_BUCKETS), list(range(EVENT_BUCKETS))
        folders = self.tables.write(events.where("event_id IS NOT NULL").withColumn("bucket", mark), "bucket", every)
        others = self.tables.write(dependents.where("event_id IS NOT NULL").withColumn("bucket", mark), "bucket", every)
        scopes = events.select(F.explode(F.array_compact(F.array(F.lit(ALL), "category"))).alias("scope")).distinct()
        before = self.tables.current()
        feed = self._feed(before, folders, keep(scopes))
        return self.tables.commit(before, {"events": (every, folders), "dependents": (every, others), "feed": feed}, {})

    def publish(self, drafts: DataFrame) -> Version:
        """Brings drafts (event_id, title, summary, visible; nulls leave what is live) into the feed. A draft of nothing, or of an event
        that is not there, publishes nothing. Every published event's live_version goes up by one, and its dependents that
        were made of an older one, or of none that is known, become stale."""
        before = self.tables.current()
        real = drafts.where("event_id IS NOT NULL AND (title IS NOT NULL OR summary IS NOT NULL OR visible IS NOT NULL)")
        new = keep(real.select("event_id", *[F.col(c).alias(f"new_{c}") for c in ("title", "summary", "visible")], bucket_of("event_id", buckets=EVENT_BUCKETS).alias("bucket")))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        stored = self.tables.read(before, "events", EVENT_SCHEMA, touched).join(new.drop("bucket").withColumn("hit", F.lit(True)), "event_id", "left")
        hit = F.coalesce("hit", F.lit(False))
        version = F.col("live_version") + hit.cast("long")
        changed = keep(stored.select(
            "event_id", "category", *[F.coalesce(f"new_{c}", c).alias(c) for c in ("title", "summary", "visible")], "last_at", version.alias("live_version"), hit.alias("hit"),
            bucket_of("event_id", buckets=EVENT_BUCKETS).alias("bucket")))
        published = changed.where("hit")
        old = self.tables.read(before, "dependents", DEPENDENT_SCHEMA, touched).join(published.select("event_id", "live_version"), "event_id", "left")
        stale = F.col("is_stale") | F.coalesce(F.coalesce("event_version", F.lit(-1).cast("long")) < F.col("live_version"), F.lit(False))
        others = old.select("dependent_id", "event_id", "event_version", stale.alias("is_stale"), bucket_of("event_id", buckets=EVENT_BUCKETS).alias("bucket"))
        folders = self.tables.write(changed.drop("hit"), "bucket", touched)
        scopes = keep(published.select(F.explode(F.array_compact(F.array(F.lit(ALL), "category"))).alias("scope")).distinct())
        every = {b: p for b, p in before.tables.get("events", {}).items() if int(b) not in touched} | folders
        feed = self._feed(before, every, scopes)
        done = self.tables.commit(before, {"events": (touched, folders), "dependents": (touched, self.tables.write(others, "bucket", touched)), "feed": feed}, {})
        discard(new, changed, scopes)
        return done

    def page(self, scope: str, n: int, cursor: str | None = None, exclude: tuple[int, ...] = ()) -> tuple[DataFrame, str | None]:
        """(rank, event_id, title, live_version) of the next ``n`` events, and the cursor of the page behind it, if there is one. A
        cursor that is none, or of another scope, begins anew with the current version."""
        at = cursor_of(cursor)
        at = at if at and at.scope == scope else Cursor(self.tables.current().number, scope, 0, tuple(dict.fromkeys(exclude))[:MOST_EXCLUDED])
        version = self.tables.version(at.version)
        asked = self.tables.spark.createDataFrame([(scope,)], "scope string")
        bucket = [r.b for r in asked.select(bucket_of("scope", buckets=SCOPE_BUCKETS).alias("b")).collect()]
        rows = self.tables.read(version, "feed", FEED_SCHEMA, bucket).where((F.col("scope") == scope) & (F.col("rank") > at.rank_after))
        rows = rows.where(~F.col("event_id").isin(*at.exclude_ids)) if at.exclude_ids else rows
        some = rows.orderBy("rank").limit(n + 1).collect()  # one more than a page
        ids = self.tables.spark.createDataFrame([(r["rank"], r["event_id"]) for r in some[:n]], "rank long, event_id long")
        own = sorted(r.b for r in ids.select(bucket_of("event_id", buckets=EVENT_BUCKETS).alias("b")).distinct().collect())
        events = self.tables.read(version, "events", EVENT_SCHEMA, own)
        shown = F.broadcast(ids).join(events, "event_id").select("rank", "event_id", "title", "live_version")
        return shown, Cursor(at.version, scope, some[n - 1]["rank"], at.exclude_ids).text() if len(some) > n else None
