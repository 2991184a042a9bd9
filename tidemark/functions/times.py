"""Times of content items: tolerant parsing, ages and decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours that an item without a time counts as old.
DEFAULT_AGE_HOURS = 168.0
FRESHNESS_GRAVITY = 1.5


def parse_utc(text: Column, naive_offset: str = "+08:00") -> Column:
    """A timestamp from ISO, RFC 2822 or ``yyyy-MM-dd HH:mm:ss`` text; times without a zone are in ``naive_offset``."""
    text = F.trim(text)
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    iso = F.regexp_replace(F.regexp_replace(text, r"Z$", "+00:00"), r"([+-]\d\d)(\d\d)$", r"$1:$2")
    absolute = F.try_to_timestamp(F.when(zoned & ~text.contains(","), iso))
    mail = F.try_to_timestamp(F.when(zoned & text.contains(","), F.regexp_replace(text, r"^\w+, ", "")), F.lit("d MMM yyyy HH:mm:ss Z"))
    naive = F.try_to_timestamp(F.when(~zoned, text))
    return F.coalesce(absolute, mail, F.to_utc_timestamp(naive, naive_offset))


def to_utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_hours(ts: Column, now: Column) -> Column:
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    hours = seconds / 3_600_000_000.0
    return F.when(hours.isNull(), DEFAULT_AGE_HOURS).otherwise(F.greatest(hours, F.lit(0.0)))


def freshness(hours: Column, gravity: float = FRESHNESS_GRAVITY) -> Column:
    return 1.0 / F.pow(1.0 + F.greatest(hours, F.lit(0.0)), F.lit(gravity))


def local_day(ts: Column, hours_ahead: int = 8) -> Column:
    return F.to_date(ts + F.expr(f"INTERVAL {hours_ahead} HOURS"))


def freshness_level(hours: Column) -> Column:
    return F.when(hours >= 72, "crit").when(hours >= 24, "warn").otherwise("ok")


def day_windows(since: Column, until: Column, days: int) -> Column:
    """Windows (start, end) from ``until`` back to ``since``, the newest first, cut at midnight every so many days."""
    midnight = F.date_trunc("day", until).cast("timestamp_ntz")
    step = F.make_dt_interval(F.lit(days))
    first = F.when(midnight == until, until - step).otherwise(midnight - F.make_dt_interval(F.lit(days - 1)))
    later = F.when(first > since, F.sequence(first, since, F.make_dt_interval(F.lit(-days)))).otherwise(F.array().cast("array<timestamp_ntz>"))
    inner = F.filter(later, lambda t: (t > since) & (t < until))
    edges = F.concat(F.array(until), inner, F.array(since))
    pairs = F.zip_with(F.slice(edges, F.lit(2), F.size(edges) - 1), F.slice(edges, F.lit(1), F.size(edges) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.when(since < until, pairs).otherwise(F.slice(pairs, F.lit(1), F.lit(0)))
