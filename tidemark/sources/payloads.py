"""Payloads of content platforms as items of one schema.

Each converter takes a DataFrame with a column ``payload`` (JSON text) and returns items. Payloads that don't parse
give null fields, never an error; rows without an id are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import parse_count

ITEM = "item_id string, platform string, source string, title string, content string, url string, author string, published_at timestamp, metrics map<string,double>, tags array<string>"
CONTENT_CHARS = 2000


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """One payload per file, with the file's name."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.input_file_name().alias("file"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; those that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def export_csv(items: DataFrame, path: str) -> None:
    """A CSV export with header, newest first."""
    items.orderBy(F.col("published_at").desc_nulls_last(), "item_id").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_reviews(reviews: DataFrame, path: str) -> None:
    """Review rows as CSV with a header, quotes doubled, line breaks kept within quotes."""
    reviews.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_reviews(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Review rows of a CSV; columns are found by the header, values that don't fit their type are null."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", False).csv(path)


def append_log(events: DataFrame, path: str) -> None:
    """An event log: one line of JSON for each event, appended."""
    events.write.mode("append").json(path)


def _epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", ""))


def _metrics(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _items(df: DataFrame, **c: Column) -> DataFrame:
    null = F.lit(None)
    out = df.select(
        c["item_id"].cast("string").alias("item_id"), F.lit(c["platform"]).alias("platform"), c.get("source", F.lit(c["platform"])).alias("source"),
        c.get("title", null).cast("string").alias("title"), F.substring(c.get("content", null).cast("string"), 1, CONTENT_CHARS).alias("content"),
        c.get("url", null).cast("string").alias("url"), c.get("author", null).cast("string").alias("author"), c.get("published_at", null).cast("timestamp").alias("published_at"),
        c.get("metrics", null).cast("map<string,double>").alias("metrics"), c.get("tags", null).cast("array<string>").alias("tags"))
    return out.where("item_id IS NOT NULL AND item_id <> ''")


def hackernews(df: DataFrame) -> DataFrame:
    p = F.from_json("payload", "id long, title string, text string, url string, `by` string, score double, descendants double, time long, type string")
    d = df.select(p.alias("p"))
    return _items(d, item_id=F.concat(F.lit("hn_"), F.col("p.id")), platform="hackernews", title=F.col("p.title"), content=strip_tags(F.col("p.text")),
                  url=F.coalesce("p.url", F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("p.id"))), author=F.col("p.by"), published_at=_epoch(F.col("p.time")),
                  metrics=_metrics(score=F.col("p.score"), comments=F.col("p.descendants")))


def reddit(df: DataFrame) -> DataFrame:
    p = F.from_json("payload", "id string, title string, selftext string, permalink string, url string, is_self boolean, score double, num_comments double, upvote_ratio double, created_utc double, link_flair_text string, author string, subreddit string")
    d = df.select(p.alias("p"))
    return _items(d, item_id=F.concat(F.lit("reddit_"), F.col("p.id")), platform="reddit", source=F.concat(F.lit("r/"), F.coalesce("p.subreddit", F.lit(""))), title=F.col("p.title"), content=F.col("p.selftext"),
                  url=F.concat(F.lit("https://www.reddit.com"), F.col("p.permalink")), author=F.col("p.author"), published_at=_epoch(F.col("p.created_utc")),
                  metrics=_metrics(score=F.col("p.score"), comments=F.col("p.num_comments"), ratio=F.col("p.upvote_ratio")), tags=F.array_compact(F.array("p.link_flair_text")))


def github(df: DataFrame) -> DataFrame:
    """Trending and list files together; the first file that names a repository wins."""
    p = F.from_json("payload", "full_name string, description string, stars double, forks double, stars_today double, language string, url string, pushed_at string, readme string")
    d = df.select(p.alias("p"), F.col("priority") if "priority" in df.columns else F.lit(0).alias("priority"))
    first = d.where("p.full_name IS NOT NULL").groupBy(F.lower("p.full_name").alias("name")).agg(F.min_by("p", F.struct("priority", "p")).alias("p"))
    return _items(first, item_id=F.concat(F.lit("gh_"), F.col("name")), platform="github", title=F.col("p.full_name"), content=F.coalesce("p.description", "p.readme"), url=F.coalesce("p.url", F.concat(F.lit("https://github.com/"), F.col("p.full_name"))),
                  author=F.substring_index("p.full_name", "/", 1), published_at=F.try_to_timestamp("p.pushed_at"),
                  metrics=_metrics(stars=F.col("p.stars"), forks=F.col("p.forks"), stars_today=F.col("p.stars_today")), tags=F.array_compact(F.array("p.language")))


def rss(df: DataFrame, prefix: str = "rss_", platform: str = "rss") -> DataFrame:
    p = F.from_json("payload", "feed_title string, feed_url string, items array<struct<id:string,link:string,title:string,content:string,summary:string,author:string,tags:array<string>,published:string>>")
    d = df.select(p.alias("p")).select("p.feed_title", F.explode("p.items").alias("e"))
    return _items(d, item_id=F.concat(F.lit(prefix), F.substring(F.md5(F.coalesce("e.id", "e.link", "e.title")), 1, 12)), platform=platform, source=F.col("feed_title"), title=strip_tags(F.col("e.title")),
                  content=strip_tags(F.coalesce("e.content", "e.summary")), url=F.col("e.link"), author=F.col("e.author"), published_at=F.try_to_timestamp("e.published"), tags=F.col("e.tags"))


def twitter(df: DataFrame) -> DataFrame:
    p = F.from_json("payload", "id string, text string, articleTitle string, articleText string, isRetweet boolean, createdAt string, author struct<name:string,screenName:string>, metrics struct<likes:double,retweets:double,views:double,replies:double,bookmarks:double>, quotedTweet struct<text:string>")
    d = df.select(p.alias("p"))
    body = F.concat_ws("\n\n", F.coalesce("p.articleText", "p.text"), F.concat(F.lit("> "), F.col("p.quotedTweet.text")))
    m = lambda k: F.col(f"p.metrics.{k}")
    return _items(d, item_id=F.col("p.id"), platform="twitter", source=F.col("p.author.screenName"), title=F.coalesce("p.articleTitle", F.substring("p.text", 1, 80)), content=body,
                  url=F.concat(F.lit("https://x.com/"), F.col("p.author.screenName"), F.lit("/status/"), F.col("p.id")), author=F.col("p.author.name"), published_at=F.try_to_timestamp("p.createdAt"),
                  metrics=_metrics(likes=m("likes"), retweets=m("retweets"), views=m("views"), replies=m("replies"), bookmarks=m("bookmarks")))


def bilibili(df: DataFrame) -> DataFrame:
    video = "struct<bvid:string,title:string,pubdate:long,owner:struct<name:string>,author:string,stats:struct<view:double,like:double,coin:double,favorite:double>>"
    each = lambda path: F.from_json(F.get_json_object("payload", path), f"array<{video}>")
    d = df.select(F.explode(F.coalesce(each("$.data.list"), each("$.items"), each("$.data"), F.from_json("payload", f"array<{video}>"))).alias("p"))
    return _items(d, item_id=F.col("p.bvid"), platform="bilibili", title=strip_tags(F.col("p.title")), url=F.concat(F.lit("https://www.bilibili.com/video/"), F.col("p.bvid")), author=F.coalesce("p.owner.name", "p.author"),
                  published_at=_epoch(F.col("p.pubdate")), metrics=_metrics(views=F.col("p.stats.view"), likes=F.col("p.stats.like"), coins=F.col("p.stats.coin"), favorites=F.col("p.stats.favorite")))


def xiaohongshu(df: DataFrame) -> DataFrame:
    note = "title string, desc string, user struct<nickname:string>, interact_info struct<liked_count:string,collected_count:string>, time long"
    at = lambda k: F.from_json(F.get_json_object("payload", f"$.{k}"), note)
    d = df.select(F.get_json_object("payload", "$.id").alias("id"), F.coalesce(at("detail"), at("note_card"), at("feed_card")).alias("p"))
    return _items(d, item_id=F.col("id"), platform="xiaohongshu", title=F.col("p.title"), content=F.col("p.desc"), url=F.concat(F.lit("https://www.xiaohongshu.com/explore/"), F.col("id")), author=F.col("p.user.nickname"),
                  published_at=_epoch(F.col("p.time") / 1000), metrics=_metrics(likes=parse_count(F.col("p.interact_info.liked_count")), collects=parse_count(F.col("p.interact_info.collected_count"))))


def lingowhale(df: DataFrame) -> DataFrame:
    p = F.from_json("payload", "entry_id string, title string, content string, abstract string, surface_url string, wechat_url string, pub_time long, channel struct<name:string>")
    d = df.select(p.alias("p"))
    return _items(d, item_id=F.col("p.entry_id"), platform="lingowhale", source=F.col("p.channel.name"), title=F.regexp_replace("p.title", r"</?hl>", ""), content=F.coalesce("p.content", "p.abstract"),
                  url=F.coalesce("p.wechat_url", "p.surface_url"), published_at=_epoch(F.col("p.pub_time")))


def daily_updates(df: DataFrame) -> DataFrame:
    """Markdown of dated sections; every link in a section is an item of its day."""
    sections = df.select(F.explode(F.split("payload", r"(?m)^(?=##? \d{4}-\d{2}-\d{2})")).alias("s")).withColumn("day", F.regexp_extract("s", r"^##? (\d{4}-\d{2}-\d{2})", 1)).where("day <> ''")
    links = sections.select("day", F.explode(F.regexp_extract_all("s", F.lit(r"(\[[^\]]+\]\([^)\s]+\))"), F.lit(1))).alias("l"))
    url = F.regexp_extract("l", r"\]\(([^)\s]+)\)", 1)
    return _items(links, item_id=F.concat(F.lit("way_"), F.substring(F.md5(url), 1, 12)), platform="waytoagi", title=F.regexp_extract("l", r"^\[([^\]]+)\]", 1), url=url, published_at=F.to_timestamp("day"))


CONVERTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "twitter": twitter, "xiaohongshu": xiaohongshu, "bilibili": bilibili, "rss": rss, "hackernews": hackernews, "reddit": reddit,
    "github": github, "lingowhale": lingowhale, "waytoagi": daily_updates,
}
