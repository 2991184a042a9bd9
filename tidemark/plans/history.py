"""History walked backward, texts of many rows, and words of texts without blanks."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import segments
from ..sources import backfill, parsers
from ..streaming.jobs import shared_dir
from .registry import query, read


@query("""
SELECT 'hn_' || event_id AS item_id, event_type AS title, value AS score, date_trunc('second', ts) AS published_at FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-02-01'""")
def backfilled_history(spark, sf_dir):
    """Events as stories, walked back from February to the tenth of January in windows of eight days that overlap by one."""
    made = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("value").alias("score"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time")))
    history = read(spark, sf_dir, "events").select(F.lit("hackernews").alias("platform"), made.alias("payload"), F.col("ts").cast("timestamp").alias("at"))
    folder = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    for _ in backfill.walk_back(history, folder, datetime(2024, 2, 1), datetime(2024, 1, 10), timedelta(days=8), timedelta(days=1)):
        pass
    return backfill.items(spark, folder).select("item_id", "title", F.element_at("metrics", F.lit("score")).alias("score"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("""
SELECT page_id, (DATE '2024-01-01' + (page_id % 28)::INT)::VARCHAR AS day, 'page ' || page_id AS title, url, NULL AS problem FROM pages WHERE page_id % 4 <> 3
UNION ALL SELECT page_id, '2024-02-01', 'again', url || '/2', NULL FROM pages WHERE page_id % 4 = 1
UNION ALL SELECT page_id, NULL, NULL, NULL, CASE WHEN page_id % 8 = 3 THEN 'no dated heading' ELSE 'no day: 2024-13-45' END FROM pages WHERE page_id % 4 = 3""")
def daily_links(spark, sf_dir):
    """Markdown of dated sections, some without a date or with one that is none, through a table function in SQL."""
    key = F.col("page_id")
    link = F.concat(F.lit("- [page "), key, F.lit("]("), "url", F.lit(") and more\n"))
    dated = F.concat(F.lit("# Updates\n\n## "), F.date_add(F.lit("2024-01-01").cast("date"), (key % 28).cast("int")).cast("string"), F.lit(" news\n"), link)
    text = (
        F.when(key % 8 == 3, link).when(key % 4 == 3, F.concat(F.lit("## 2024-13-45\n"), link))
        .when(key % 4 == 1, F.concat(dated, F.lit("## 2024-02-01\n* [again]("), "url", F.lit("/2)\n"))).otherwise(dated)
    )
    parsers.register(spark)
    read(spark, sf_dir, "pages").select("page_id", text.alias("markdown")).createOrReplaceTempView("daily_markdown")
    return spark.sql("SELECT page_id, CAST(l.day AS STRING) AS day, l.title, l.url, l.problem FROM daily_markdown, LATERAL daily_links(markdown) AS l")


@query(r"""
SELECT conv_id, (turn + 1)::INT AS number, turn * 2500 AS start_ms, CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 5 = 3 THEN turn * 2500 - 1 ELSE turn * 2500 + 2000 END AS end_ms, said, CASE WHEN turn % 5 = 4 THEN 'no times' WHEN turn % 5 = 3 THEN 'ends before it begins' END AS problem
FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE role END AS said FROM conversations) WHERE turn % 5 <> 4
UNION ALL SELECT conv_id, (turn + 1)::INT, NULL, NULL, (turn + 1) || chr(10) || 'soon' || chr(10) || role, 'no times' FROM conversations WHERE turn % 5 = 4""")
def conversation_cues(spark, sf_dir):
    """Turns as cues of a subtitle text per conversation, some without times or with an end that comes too early."""
    turn = F.col("turn")
    clock = lambda ms: F.concat(F.lpad((ms / 3600000).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((ms / 60000 % 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((ms / 1000 % 60).cast("int").cast("string"), 2, "0"), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))
    end = F.when(turn % 5 == 3, turn * 2500 - 1).otherwise(turn * 2500 + 2000)
    times = F.when(turn % 5 == 4, "soon").otherwise(F.concat(clock(turn * 2500), F.lit(" --> "), clock(end)))
    block = F.concat((turn + 1).cast("string"), F.lit("\n"), times, F.lit("\n"), "role")
    texts = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("cues"))
    parsers.register(spark)
    texts.createOrReplaceTempView("conversation_subtitles")
    return spark.sql("SELECT conv_id, c.number, c.start_ms, c.end_ms, c.text AS said, c.problem FROM conversation_subtitles, LATERAL subtitle_cues(cues) AS c")


@query()
def segmented_texts(spark, sf_dir):
    """Every turn's letters without blanks, cut into words again by the counts of all turns' words."""
    turns = read(spark, sf_dir, "conversations")
    words = turns.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    cut = segments.segmented(F.regexp_replace("text", r"\s+", ""), segments.vocabulary(words))
    return turns.select("conv_id", "turn", F.array_join(cut, " ").alias("words"))
