"""Small cases of operators, sources and entry."""

from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import events, feeds, merges
from tidemark.sources import payloads


def test_upsert_rules(spark):
    schema = "item_id string, title string, lang string, content string, url string, author string, summary string, metrics int"
    old = spark.createDataFrame([("a", "t", "en", "long content", "u", "x", None, 1)], schema)
    new = spark.createDataFrame([("a", "T", "de", "short", "", "y", "s", 2), ("b", "n", "fr", None, None, None, None, None)], schema)
    rows = {r.item_id: r for r in merges.upsert_items(old, new).collect()}
    a = rows["a"]
    assert (a.title, a.lang, a.content, a.url, a.author, a.summary, a.metrics, a.was_inserted) == ("t", "en", "long content", "u", "y", "s", 2, False)
    assert rows["b"].was_inserted


def test_anonymous_reads_join_nothing(spark):
    items = spark.createDataFrame([(1,)], "item_id long")
    status = spark.createDataFrame([(1, 5, True)], "item_id long, user_id long, starred boolean")
    assert feeds.with_status(items, status, None).first().starred is None
    assert feeds.with_status(items, status, 5).first().starred is True


def test_category_aliases(spark):
    df = spark.createDataFrame([("Tools/cli",), ("coding/x",), ("",), (None,)], "c string")
    assert [r.c for r in df.select(feeds.canonical_category(F.col("c")).alias("c")).collect()] == ["efficiency_tools", "coding", None, None]


def test_components_of_a_long_path(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = events.connected(edges, spark.range(45))
    assert {r.id: r.label for r in labels.collect()} == {i: 0 if i <= 40 else i for i in range(45)}


def test_bad_payloads_give_no_rows(spark):
    df = spark.createDataFrame([("{not json",), ("{}",), (None,)], "payload string")
    for convert in payloads.CONVERTERS.values():
        assert convert(df).collect() == []


def test_payloads(spark):
    make = lambda text: spark.createDataFrame([(text,)], "payload string")
    rss = payloads.rss(make('{"feed_title": "F", "items": [{"id": "1", "title": "<b>T</b>", "link": "l", "content": "c"}]}')).first()
    assert (rss.title, rss.source, rss.item_id[:4]) == ("T", "F", "rss_")
    gh = payloads.github(make('{"full_name": "A/B", "stars": 5}')).first()
    assert (gh.item_id, gh.metrics["stars"]) == ("gh_a/b", 5.0)
    way = payloads.daily_updates(make("# 2026-01-02\n[one](http://a)\n# 2026-01-01\n[two](http://b)")).collect()
    assert {(r.title, str(r.published_at.date())) for r in way} == {("one", "2026-01-02"), ("two", "2026-01-01")}
    video = payloads.bilibili(make('{"data": {"list": [{"bvid": "BV1", "title": "v", "pubdate": 0}]}}')).first()
    assert video.item_id == "BV1"


def test_whole_table_queries_leave_no_row_out(spark):
    sf = "/root/testdata/sf0.001"
    queries, count = __spark_entry__.queries(), lambda name: spark.read.parquet(f"{sf}/{name}.parquet").count()
    assert queries["source_health_7d_whole"](spark, sf).count() == count("customer")
    assert queries["source_items_whole"](spark, sf).count() == count("events")
    vec = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = queries["topk_recall_whole"](spark, sf).where("q = s")
    assert sorted(r.q for r in asked.collect()) == sorted(r.vec_id for r in vec.where("vec_id % 20 = 0").collect())
    many = vec.groupBy("label").count().where("count > 1").select("label")
    assert queries["cosine_histogram_whole"](spark, sf).select("label").distinct().join(many, "label").count() > 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_agglomeration_is_one_pass(spark):
    """Each window against a plain pass: an item joins the nearest centroid that allows it, or founds a cluster."""
    import numpy as np

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 4)) + np.repeat(rng.normal(size=(6, 4)) * 2, 10, axis=0)
    rows = [(i % 2, i, int(rng.integers(100)), v.tolist()) for i, v in enumerate(vectors)]
    got = {(r.w, r.id): r.cluster for r in events.agglomerate(spark.createDataFrame(rows, "w long, id long, newest int, v array<double>"), "w", "id", ["newest", "id"], "v").collect()}
    for window in (0, 1):
        clusters = []
        for _, i, _, v in sorted((r for r in rows if r[0] == window), key=lambda r: (r[2], r[1])):
            u = np.array(v) / np.linalg.norm(v)
            ranked = sorted(((-(np.mean(c, axis=0) / np.linalg.norm(np.mean(c, axis=0)) @ u), k) for k, c in enumerate(clusters)))
            fits = [k for near, k in ranked if -near >= events.CANDIDATE and len(clusters[k]) < events.MOST_MEMBERS and min(m @ u for m in clusters[k]) >= events.DIAMETER]
            k = fits[0] if fits else len(clusters)
            clusters[k:k] = [] if fits else [[]]
            clusters[k].append(u)
            assert got[window, i] == k


def test_cluster_faults_pair_by_pair(spark):
    import random

    from tidemark.operators import evaluation

    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([1, 2, 3, 4, None])) for _ in range(60)] + [("z", 9), ("z", 9)]
    got = evaluation.cluster_faults(spark.createDataFrame(rows, "t string, p int"), "t", "p").first()
    tn = sum(a[0] != b[0] and a[1] != b[1] for i, a in enumerate(rows) for b in rows[i + 1 :])
    mixed = {p for _, p in rows if len({t for t, q in rows if q == p}) > 1}
    split = {t for t, _ in rows if len({p for u, p in rows if u == t}) > 1}
    assert tuple(got) == (tn, len(mixed), sum(p in mixed for _, p in rows), len(split), len(rows))
