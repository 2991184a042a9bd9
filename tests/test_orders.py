"""Broken answers, titles kept in order and quotas against plain versions."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tidemark.functions import answers
from tidemark.operators import actions, quotas
from tidemark.plans import orders

# broken answers


def letter_by_letter(text):
    """The outermost whole objects, one character after the other."""
    found, depth, begin, quoted, escaped = [], 0, 0, False, False
    start = text.find("[") + 1 if "[" in text else max(text.find("{"), 0)
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c == "{":
            begin, depth = (i if not depth else begin), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    if isinstance(json.loads(text[begin : i + 1]), dict):
                        found.append(text[begin : i + 1])
                except ValueError:
                    pass
    return found


def test_salvage_letter_by_letter():
    rng = random.Random(4)
    whole = json.dumps([{"a": "x } \" [ \\", "b": {"c": [1, {"d": "{"}]}}, {"e": "é\n"}, 7, "s", {"f": None}], ensure_ascii=False)
    for i in range(len(whole) + 1):
        assert answers.whole_objects(whole[:i]) == letter_by_letter(whole[:i])
    signs = ['"', "\\", "{", "}", "[", "]", ":", "1", '"a"', '{"a": 1}', '{"b": "', "\n", "é", ","]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 25)))
        assert answers.whole_objects(text) == letter_by_letter(text), text


def test_objects_of_answers(spark):
    one, two = '{"t": "a"}', '{"t": "b", "n": {"m": "}"}}'
    cases = {
        f"[{one}, {two}]": 2, f"```json\n[{one}]\n```": 1, f'{{"actions": [{one}, 5]}}': 1, f'{{"other": [{one}]}}': 0, f"Look: [{one}, {two}] well": 2,
        f"[{one}, {two}, {{\"t\": \"cut": 2, f"[{one}, {{bad}}, {two},]": 2, one: 0, f"{one} {two}": 2, "": 0, "[": 0, "no": 0, "{" * 3000: 0, "[" * 5000: 0, f"<think>[hm]</think> [{one}]": 1,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, 0)], "a string, n int")
    for r in df.select("a", "n", F.size(answers.objects(F.col("a"))).alias("got")).collect():
        assert r.got == r.n, r.a


def test_relaxed_strings(spark):
    cases = [
        ('{"t": "plain", "s": "x"}', "plain", "x"), ('{"t": "two\nlines", "s": "say \\"hi\\""}', "two\nlines", 'say "hi"'), ('{"t": "with "quotes" in", "s": "end"', 'with "quotes" in', "end"),
        ('say {"t": "a\\\\nb", "s": ""}', "a\\nb", ""), ('{"s": "only\n"}', None, "only"), ("nothing", None, None), (None, None, None), ('{"t": "cut off', None, None), ('{"t": "a", bad "s": "b"}', 'a", bad "s": "b', "b"),
    ]
    df = spark.createDataFrame([(a, i) for i, (a, _, _) in enumerate(cases)], "a string, i int")
    got = df.select("i", answers.strings(F.col("a"), ["t", "s"]).alias("x")).orderBy("i").collect()
    assert [(r.x.t, r.x.s) for r in got] == [(t, s) for _, t, s in cases]


# titles


def one_by_one(new, known, least=10):
    seen = {t.lower().strip(" ") for _, t in known if t and t.strip(" ")}
    out = []
    for i, t in sorted((r for r in new if r[0] is not None), key=lambda r: r[0]):
        t = (t or "").lower().strip(" ")
        if not any(t == s or (len(t) > least and t in s) or (len(s) > least and s in t) for s in seen):
            seen.add(t)
            out.append(i)
    return out


def test_titles_one_by_one(spark):
    rng = random.Random(7)
    for seed in range(3):
        text = "".join(rng.choice("ab ") for _ in range(60)) if seed else "abcdefghijklmnopqrstuvwxyz0123456789" * 2
        part = lambda: (lambda i: text[i : i + rng.randint(0, 30)])(rng.randrange(50))  # noqa: B023, E731
        new = [(i, rng.choice([part(), part().upper(), " " + part(), None if i % 9 == 0 else part()])) for i in rng.sample(range(1000), 120)] + [(None, "none")]
        known = [(i, part()) for i in range(3 * seed)] + [(99, None)]
        schema = "id long, title string"
        got = actions.kept_in_order(spark.createDataFrame(new, schema), spark.createDataFrame(known, schema))
        assert sorted(r.id for r in got.collect()) == one_by_one(new, known)


def test_chain_of_containment_takes_turns(spark):
    """Each title holds the one before it: the first stays, all others go; and where a kept one lies between, every other one."""
    long = "abcdefghijklmnopqrstuvwxyz" * 4
    chain = [(i, long[: 20 + i]) for i in range(40)]
    apart = [(100 + i, "#" + long[i * 2 : i * 2 + 12]) for i in range(10)] + [(200 + i, "+#" + long[i * 2 : i * 2 + 12] + "+") for i in range(10)]
    rows = chain + apart
    got = actions.kept_in_order(spark.createDataFrame(rows, "id long, title string"), spark.createDataFrame([], "id long, title string"))
    assert sorted(r.id for r in got.collect()) == one_by_one(rows, []) == [0, *range(100, 110)]


def test_query_of_titles(spark):
    sf_dir = "/root/testdata/sf0.001"
    new, known = (df.collect() for df in orders.titles(spark, sf_dir))
    assert sorted(r.id for r in orders.titles_kept_in_order(spark, sf_dir).collect()) == one_by_one(new, known)


# quotas


def test_quota_is_a_loop_and_no_running_sum(spark):
    rng = random.Random(8)
    t0 = dt.datetime(2026, 1, 1, 10)
    calls = [(rng.choice([1, 2, None]), t0 + dt.timedelta(minutes=rng.randrange(4000)), i, rng.choice([None, -5, 0, 10, 40, 70, 120])) for i in range(400)] + [(1, None, 1000, 1)]
    df = spark.createDataFrame(calls, "user_id long, ts timestamp, call_id long, cost long").withColumn("_x", F.lit(1)).repartition(5)
    got = {r.call_id: (r.admitted, r.used) for r in quotas.admitted(df, 100).collect()}
    used, wanted, sums, differs = {}, {}, {}, 0
    for user, ts, i, cost in sorted((c for c in calls if c[1]), key=lambda c: (c[1], c[2])):
        day, cost = (user, (ts + dt.timedelta(hours=8)).date()), max(cost or 0, 0)
        fits = used.get(day, 0) + cost <= 100
        used[day] = used.get(day, 0) + cost * fits
        sums[day] = sums.get(day, 0) + cost
        differs += fits != (sums[day] <= 100)
        wanted[i] = (fits, used[day])
    assert got.pop(1000)[0] is False
    assert got == wanted and differs > 20
    usage = {(r.user_id, r.day): (r.used, r.left) for r in quotas.day_usage(df, 100).collect()}
    assert usage == {k: (v, 100 - v) for k, v in used.items()}
    assert quotas.admitted(df.limit(0), 100).count() == 0
