"""Back-fill, parsers of many rows, segmentation and broken lines."""

import itertools
import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import segments
from tidemark.sources import backfill, parsers

NOW, UNTIL = datetime(2026, 3, 1), datetime(2026, 2, 1)


def history(spark, rows):
    made = [("hackernews", f'{{"id": {i}, "title": "t{i}", "time": {int((at - datetime(1970, 1, 1)).total_seconds())}}}', at) for i, at in rows]
    made += [("hackernews", "{bad", NOW - timedelta(days=1)), ("hackernews", None, NOW - timedelta(days=2)), ("nowhere", "{}", NOW - timedelta(days=2)), ("hackernews", '{"id": 999}', None)]
    return spark.createDataFrame(made, "platform string, payload string, at timestamp")


def test_windows():
    assert list(backfill.windows(NOW, UNTIL, timedelta(days=10)))[-1] == (UNTIL, NOW - timedelta(days=20))
    assert list(backfill.windows(NOW, NOW, timedelta(days=10))) == []


def test_walk_that_is_cut_off_gives_each_row_once(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, NOW - timedelta(hours=rng.randrange(-30, 28 * 24 + 60))) for i in range(150)]
    rows += [(7, rows[7][1] + timedelta(hours=1))]  # twice in the history
    folder, walk = str(tmp_path), (NOW, UNTIL, timedelta(days=6), timedelta(days=1))
    steps = backfill.walk_back(history(spark, rows), folder, *walk)
    next(steps), next(steps)
    steps.close()
    (tmp_path / "items" / "window=1" / "_SUCCESS").unlink()  # as if it had died in the second one
    assert backfill.finished(spark, folder) == 1
    late = (500, NOW - timedelta(days=6) + timedelta(hours=2))  # comes in behind a window that is done, within the overlap
    assert len(list(backfill.walk_back(history(spark, [*rows, late]), folder, *walk))) == 4
    got = sorted(r.item_id for r in backfill.items(spark, folder).collect())
    assert got == sorted({f"hn_{i}" for i, at in [*rows, late] if UNTIL < at <= NOW})
    assert list(backfill.walk_back(history(spark, rows), folder, *walk)) == []


def test_table_functions(spark):
    parsers.register(spark)
    markdown = "intro [no](x)\n## 2026-01-02 Fri\n* [a b](http://x/1) [c](http://x/2 title)\n### 2026-01-03\n[deep](u)\n# 2026-02-30\n[bad](day)\n# 2026-01-04\n[d](v)"
    spark.createDataFrame([(1, markdown), (2, "nothing"), (3, None), (4, " ")], "id int, t string").createOrReplaceTempView("texts_in")
    got = {tuple(r) for r in spark.sql("SELECT id, l.* FROM texts_in, LATERAL daily_links(t) l").collect()}
    day = date(2026, 1, 2)
    assert got == {(1, day, "a b", "http://x/1", None), (1, day, "deep", "u", None), (1, None, None, None, "no day: 2026-02-30"), (1, date(2026, 1, 4), "d", "v", None), (2, None, None, None, "no dated heading")}
    cues = "WEBVTT\n\n1\n00:00:01,500 --> 00:00:02,000\none\ntwo\n\n00:03.000 --> 00:04.000\nthree\n\n7\nno time\n\n9\r\n01:00:00.000 --> 00:59:59.000\r\nback\n\n\n"
    spark.createDataFrame([(1, cues), (2, None), (3, "42")], "id int, t string").createOrReplaceTempView("cues_in")
    got = [tuple(r) for r in spark.sql("SELECT id, c.* FROM cues_in, LATERAL subtitle_cues(t) c").collect()]
    assert sorted(got, key=repr) == sorted([
        (1, 1, 1500, 2000, "one\ntwo", None), (1, None, 3000, 4000, "three", None), (1, 7, None, None, "7\nno time", "no times"), (1, 9, 3600000, 3599000, "back", "ends before it begins"), (3, None, None, None, "42", "no times")], key=repr)


# segmentation


def every_path(run, counts):
    """The best of all ways to cut a run."""
    total = sum(counts.values()) or 1
    best = None
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(run)]
        words = [run[a:b] for a, b in zip([0, *ends], ends)]
        if all(w in counts or len(w) == 1 for w in words):
            cost = sum(-math.log(counts[w] / total) if w in counts else math.log(total) + math.log(10) for w in words)
            key = (round(cost, 7), len(words), [-len(w) for w in words])
            best = min(best or (key, words), (key, words))
    return best[1]


def test_best_path_against_all_paths():
    rng = random.Random(5)
    for _ in range(300):
        letters = rng.choice(["ab", "abc", "北京大学"])
        counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): rng.choice([1, 1, 2, 4, 8, 50]) for _ in range(rng.randint(0, 9))}
        run = "".join(rng.choice(letters + "x") for _ in range(rng.randint(1, 9)))
        assert segments.Lattice(counts).best(run) == every_path(run, counts), (run, counts)


def test_segmented_texts(spark):
    counts = segments.vocabulary(spark.createDataFrame([("北京", 50), ("大学", 40), ("北京大学", 30), ("the", 90), ("cat", 9), ("they", 3), ("x" * 40, 99), (None, 9), ("", 9), ("zero", 0)], "word string, n long"))
    assert set(counts) == {"北京", "大学", "北京大学", "the", "cat", "they"}
    assert list(segments.vocabulary(spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "word string, n long"), 2)) == ["b", "c"]
    df = spark.createDataFrame([("TheCat,北京大学1the",), ("",), ("12",), (None,), ("q" * 5000,)], "t string")
    got = [r.w for r in df.select(segments.segmented(F.col("t"), counts).alias("w")).collect()]
    assert got[:4] == [["the", "cat", "北京大学", "the"], [], [], None] and got[4] == ["q"] * 5000
    assert [r.w for r in df.limit(1).select(segments.segmented(F.col("t"), {}).alias("w")).collect()] == [list("thecat北京大学the")]


@pytest.mark.parametrize(("text", "wanted"), [
    ("one\ntwo", "one\ntwo"), ("", ""), (None, ""), ("a\r\nb\rc", "a\nb\nc"),
    ("Op\nen\nA\nI\n发布\n，\n新\n模型", "Open AI 发布，新模型"),
    ("【要点】\n这\n是\nG\nPT\n\n\n3、结论：\n好\n的\n。\nend", "【要点】\n这是 GPT\n\n3、结论：\n好的。 end"),
    ("NPC\n角\n色\n（\nx\n）", "NPC 角色（x）"),
    ("\n".join(["a long line of text here"] * 9), "\n".join(["a long line of text here"] * 9)),
])
def test_broken_lines(text, wanted):
    assert segments.joined(text) == wanted


def test_broken_lines_as_a_column(spark):
    df = spark.createDataFrame([("Op\nen\nA\nI\n发布",), (None,)], "t string")
    assert [r.j for r in df.select(segments.joined_lines(F.col("t")).alias("j")).collect()] == ["Open AI 发布", ""]
