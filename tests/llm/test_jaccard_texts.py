"""The n-gram Jaccard join moves a text once."""

import re

from pyspark.sql import functions as F
from tidemark.llm import common, jaccard_join, repeats

from test_llm_operators import SCHEMA, corpus


def test_texts_are_shuffled_once(spark):
    """No join by row brings texts to their nodes; only the first row of a node in a batch has its text."""
    rows = [r for r in corpus() if r[1]]
    fresh = jaccard_join.describe(spark.createDataFrame(rows + rows[:5], SCHEMA).coalesce(1)).where("vector is not null")
    texts = {r.node: repeats.unpack(bytes(r.packed)).decode() for r in fresh.collect()}
    assert fresh.count() == len(texts) and set(texts.values()) <= {r[1] for r in rows}
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = jaccard_join.node_texts(fresh, fresh.select("node").distinct())
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        got = {r.node: repeats.unpack(bytes(r.packed)).decode() for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    moved = [x for x in re.findall(r"\(\d+\) Exchange\nInput[^\n]*", plan) if "packed#" in x]
    assert len(moved) == 1 and got.keys() == texts.keys()
    assert {t.lower().split()[0] for t in got.values()} == {t.lower().split()[0] for t in texts.values()}


def test_only_texts_of_likely_pairs_are_written(spark, monkeypatch):
    """Of 60 texts, the two near copies alone leave the table they came from; the others' texts are written nowhere."""
    words = [[f"w{i}x{j}" for j in range(80)] for i in range(60)]
    words[41] = [*words[7][:79], "other"]
    words[52][:4] = words[3][:4]  # one shingle in common is a block, but no likely pair
    held = []

    def noting(write):
        def run(df, *by):
            out = write(df, *by)
            if {"packed", "text"} & set(out.columns):
                held.append(sorted(repeats.unpack(bytes(r.packed)).decode().split()[0] for r in out.where("packed is not null").collect()))
            return out

        return run

    for name in ("keep", "keep_by"):
        monkeypatch.setattr(jaccard_join, name, noting(getattr(jaccard_join, name)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(docs).collect()}
    assert got == {i: 7 if i == 41 else i for i in range(60)}
    assert max(held) == ["w7x0", "w7x0"] and all(x in ([], ["w7x0", "w7x0"]) for x in held)


def test_where_likely_loses_no_row(spark):
    """All rows of the keys stay, hardly any other one does, and few bits only let more rows through."""
    rows = spark.range(20000).withColumn("x", F.col("id") * 2)
    keys = spark.range(0, 20000, 100)
    for words, most in ((1 << 19, 210), (1, 20000)):
        got = {r.id for r in common.where_likely(rows, keys, "id", words).collect()}
        assert set(range(0, 20000, 100)) <= got and len(got) <= most
    assert common.where_likely(rows, keys.limit(0), "id").count() == 0
