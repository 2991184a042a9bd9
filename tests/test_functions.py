"""Hand-computed cases of the column builders."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores, texts, times, urls, vectors


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, t in TYPES.items() if k in row)) if row else spark.range(1)
    return df.select(column.alias("x")).first().x


TYPES = {"s": "string", "d": "double", "v": "array<float>", "w": "array<float>", "n": "long"}


@pytest.mark.parametrize("text, want", [
    ("2026-01-01 08:00:00", datetime(2026, 1, 1)), ("2026-01-01T00:00:00Z", datetime(2026, 1, 1)), ("2026-01-01T08:00:00+0800", datetime(2026, 1, 1)),
    ("Thu, 01 Jan 2026 00:00:00 +0000", datetime(2026, 1, 1)), ("soon", None), ("", None), (None, None),
])
def test_parse_utc(spark, text, want):
    assert one(spark, times.parse_utc(F.col("s")), s=text) == want


def test_freshness_and_age(spark):
    assert one(spark, times.freshness(F.col("d")), d=0.0) == 1.0
    assert one(spark, times.freshness(F.col("d")), d=3.0) == pytest.approx(0.125)
    assert one(spark, times.age_hours(F.lit(None).cast("timestamp"), F.current_timestamp())) == 168.0


@pytest.mark.parametrize("text, want", [("1.2万", 12000), ("35", 35), ("", 0), (None, 0), ("many", 0), ("1.2.3万", 0)])
def test_parse_count(spark, text, want):
    assert one(spark, texts.parse_count(F.col("s")), s=text) == want


@pytest.mark.parametrize("text, want", [("你好 ab", 2), ("", 0), (None, 0), ("abcd", 1)])
def test_token_estimate(spark, text, want):
    assert one(spark, texts.token_estimate(F.col("s")), s=text) == want


def test_head_tail(spark):
    assert one(spark, texts.head_tail(F.col("s"), 20), s="short") == "short"
    cut = one(spark, texts.head_tail(F.col("s"), 20), s="a" * 50 + "z" * 50)
    assert len(cut) == 20 and cut.startswith("a" * 10) and cut.endswith("z" * 5)


def test_urls(spark):
    assert one(spark, urls.canonical_url(F.col("s")), s=" HTTP://EX.com/p?utm_source=a&id=1#f ") == "http://ex.com/p?id=1"
    assert one(spark, urls.canonical_url(F.col("s")), s="no url") is None
    assert one(spark, urls.url_identity(F.col("s")), s="https://twitter.com/a/status/1?x=1")[1:] == ("1", "https://x.com/a/status/1")
    assert one(spark, urls.url_identity(F.col("s")), s="https://youtu.be/abcdefghijk").item_id == "yt_abcdefghijk"
    assert one(spark, urls.source_identity(F.col("s"), F.lit("7")), s="https://github.com/A/B.git") == "github:a/b"
    assert one(spark, urls.source_identity(F.col("s"), F.lit("7")), s="") == "7"


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.col("v"), F.col("w")), v=[0.0, 0.0], w=[1.0, 0.0]) == 0.0
    assert one(spark, vectors.cosine(F.col("v"), F.col("w")), v=[3.0, 4.0], w=[4.0, 3.0]) == pytest.approx(0.96)
    assert one(spark, vectors.cosine(F.col("v"), F.col("w")), v=[1.0], w=[1.0, 0.0]) == 0.0


def test_score10(spark):
    dims = lambda **k: {d: F.lit(k.get(d, 3)) for d in scores.DIMENSIONS}
    assert one(spark, scores.score10(F.lit("general"), F.lit(0.9), dims(), F.lit(0))) == 10.0
    assert one(spark, scores.score10(F.lit("general"), F.lit(0.9), dims(authority=0), F.lit(0))) == 4.9
    assert one(spark, scores.score10(F.lit("product_tool"), F.lit(0.5), dims(novelty=0), F.lit(0))) == 5.9


def test_highlight_grows_with_sources(spark):
    at = lambda n: one(spark, scores.highlight(F.lit(8.0), F.lit(6.0), F.lit(n)))
    assert at(0) == at(1) < at(2) < at(5)
    assert one(spark, scores.highlight(F.lit(None).cast("double"), F.lit(1.0), F.lit(1))) is None


def test_url_identity_of_many_forms(spark):
    v, w = "aB3-_cdEfGh", "https://www.youtube.com/watch?v=aB3-_cdEfGh"
    cases = {
        f"https://www.youtube.com/watch?v={v}": w, f"http://m.youtube.com/watch?t=1&v={v}&list=x#t=3": w, f"youtu.be/{v}?si=1": w, f"https://YouTube.com/shorts/{v}/": w, f"https://youtube.com/embed/{v}": w,
        f"https://youtube.com:443/live/{v}": w, f"https://youtube.com/watch?v={v}xyz": w, "https://youtube.com/watch?v=short": None, f"https://youtube.com/watch?vv={v}": None, f"https://youtube.com/list/{v}": None,
        f"https://notyoutube.com/watch?v={v}": None, "https://youtube.com/watch?v=aB3+_cdEfGh": None, "https://youtube.com/watch": None,
        "https://Twitter.com/Ann/status/123?s=20": "https://x.com/Ann/status/123", "x.com/i/status/5/photo/1": "https://x.com/i/status/5", "https://mobile.twitter.com/a/status/77abc": "https://x.com/a/status/77",
        "https://x.com/a/status/": None, "https://x.com/a/statuses/1": None, "https://x.com//status/1": None, "https://netflix.com/a/status/1": None, "https://example.com/?u=x.com/a/status/1": None, "": None,
    }
    df = spark.createDataFrame([(k, c) for k, c in cases.items()] + [(None, None)], "u string, c string")
    for r in df.select("u", "c", urls.url_identity(F.col("u")).alias("got")).collect():
        assert r.got.canonical == (r.c or r.u or "") and (r.got.platform == "manual") == (r.c is None), r.u
