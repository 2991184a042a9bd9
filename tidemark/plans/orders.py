"""Answers that are broken, titles kept in order, and calls under a quota."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers
from ..operators import actions, quotas
from .registry import query, read


@query("""
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 0 ELSE 3 END AS n,
  CASE p_partkey % 6 WHEN 5 THEN '' WHEN 3 THEN p_name || '|' || p_brand WHEN 4 THEN p_name || '|' || p_type ELSE p_name || '|' || p_brand || '|' || p_type END AS titles,
  CASE WHEN p_partkey % 6 = 5 THEN NULL WHEN p_partkey % 2 = 0 THEN 'a "' || p_name || '"' || chr(10) || 'b\\c' ELSE p_name END AS headline
FROM part""")
def salvaged_answers(spark, sf_dir):
    """Objects of answers that are whole, in fences, under a field, cut off, broken in the middle, or none; and a headline from
    one that is not quite JSON."""
    part, key = read(spark, sf_dir, "part"), F.col("p_partkey")
    one = lambda c: F.concat(F.lit('{"title": "'), c, F.lit('", "note": "a } in \\"text\\" [", "deep": {"x": {}}}'))
    a, b, c = one("p_name"), one("p_brand"), one("p_type")
    bad = F.lit('{"title": bad, "note": 1}')
    whole = F.concat(F.lit("["), a, F.lit(", "), b, F.lit(",\n"), c, F.lit("]"))
    said = (
        F.when(key % 6 == 0, whole).when(key % 6 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(key % 6 == 2, F.concat(F.lit('{"actions": '), whole, F.lit("}")))
        .when(key % 6 == 3, F.concat(F.lit("Here: ["), a, F.lit(", "), b, F.lit(', {"title": "cut o')))
        .when(key % 6 == 4, F.concat(F.lit("["), a, F.lit(", "), bad, F.lit(", "), c, F.lit(", ]")))
        .otherwise(F.lit("I can't do that."))
    )
    loose = F.when(key % 6 == 5, F.lit("nothing")).when(key % 2 == 0, F.concat(F.lit('{"headline": "a "'), "p_name", F.lit('"\nb\\\\c", "more": 1')))
    loose = loose.otherwise(F.concat(F.lit('Yes: {"headline": "'), "p_name", F.lit('", "more": 1} there')))
    found = part.select(key.alias("id"), answers.objects(said).alias("o"), answers.strings(loose, ["headline"])["headline"].alias("headline"))
    titles = F.transform("o", lambda o: F.get_json_object(o, "$.title"))
    return found.select("id", F.size("o").alias("n"), F.array_join(titles, "|").alias("titles"), "headline")


def titles(spark, sf_dir):
    """Beginnings of documents as titles, of other lengths for each, and every eleventh one as known before."""
    docs = read(spark, sf_dir, "documents")
    new = docs.select(F.col("doc_id").alias("id"), F.expr("substr(text, 1 + cast(doc_id % 4 AS int) * 3, 14 + cast(doc_id * 7 % 30 AS int))").alias("title"))
    return new.where("id % 11 <> 0"), new.where("id % 11 = 0")


@query()
def titles_kept_in_order(spark, sf_dir):
    """Order dependent: each title is held against the known ones and those kept before it."""
    return actions.kept_in_order(*titles(spark, sf_dir))


@query("""
WITH RECURSIVE calls AS (
  SELECT user_id, (ts + INTERVAL 8 HOUR)::DATE AS day, event_id, greatest(floor(value)::BIGINT, 0) AS cost, row_number() OVER (PARTITION BY user_id, (ts + INTERVAL 8 HOUR)::DATE ORDER BY ts, event_id) AS i FROM events),
fold AS (
  SELECT user_id, day, event_id, i, cost <= 150 AS admitted, CASE WHEN cost <= 150 THEN cost ELSE 0 END AS used FROM calls WHERE i = 1
  UNION ALL SELECT c.user_id, c.day, c.event_id, c.i, f.used + c.cost <= 150, CASE WHEN f.used + c.cost <= 150 THEN f.used + c.cost ELSE f.used END FROM fold f JOIN calls c ON c.user_id = f.user_id AND c.day = f.day AND c.i = f.i + 1)
SELECT user_id, day::VARCHAR AS day, event_id, admitted, used FROM fold""")
def quota_admissions(spark, sf_dir):
    """Which events a daily quota of 150 lets through."""
    calls = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.floor("value").cast("long").alias("cost"))
    return quotas.admitted(calls, 150, key="event_id").select("user_id", F.col("day").cast("string").alias("day"), "event_id", "admitted", "used")
