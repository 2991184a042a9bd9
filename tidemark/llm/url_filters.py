"""URL filters: host-suffix and path-prefix rules found by an equi-join on short hashes.

A rule is a string ``host/path``. It fits a url if the url's host is the rule's host or a subdomain of it and the
url's path starts with the rule's path, which ends in ``/``. Of the rules that fit, the longest wins, then the one
with the longer host, then the one that sorts first; a rule given twice with both verdicts blocks.

Null urls and urls without ``://`` have an empty host and path and fit no rule. A url that no rule fits gets the
default verdict, ``allow``. Repeated pages keep one row each; other columns of ``pages`` are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Hexadecimal digits of the digest that the join compares before full digests are confirmed.
PREFIX_DIGITS = 8

#: The rules that the query judges by.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: str | Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: int) -> Column:
    """The host and each suffix of it that begins after a dot, of at most ``most`` labels."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.greatest(n - (most - 1), F.lit(1)), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def path_prefixes(path: Column, most: int) -> Column:
    """Each prefix of the path that ends in one of its first ``most`` slashes."""
    parts = F.split(path, "/", most + 1)
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)),
        lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Returns page_id, host, path, rule, verdict; ``rules`` has columns rule and verdict."""
    rules = (
        rules.where("rule is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
        .withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )
    # urls are expanded as far as the deepest rule reaches, so a long one costs no more than a short one
    labels, slashes = rules.agg(
        F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))), F.max(F.length("rule") - F.length(F.replace("rule", F.lit("/"))))
    ).first()
    parsed = pages.select("page_id", url_host("url").alias("host"), url_path("url").alias("path"))
    # hosts and paths repeat (a hot host may hold a third of the pages): each pair is expanded once
    places = parsed.where("host <> '' and path <> ''").select("host", "path").distinct()
    expressions = places.select(
        "host", "path", F.explode(host_suffixes(F.col("host"), labels or 1)).alias("suffix")
    ).select("host", "path", "suffix", F.explode(path_prefixes(F.col("path"), slashes or 1)).alias("prefix"))
    hashed = expressions.select(
        "host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("full")
    ).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    hits = hashed.join(rules, "short").where("full = digest")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(
            F.length("rule").alias("size"),
            F.instr("rule", "/").alias("host_size"),
            # of equal sizes the rule that sorts first wins, so codes are turned round
            F.translate(F.hex("rule"), "0123456789ABCDEF", "FEDCBA9876543210").alias("turned"),
            F.col("rule"), F.col("verdict"),
        )).alias("best")
    )
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


ORACLE = r"""
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
split AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
parsed AS (
  SELECT page_id,
         lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT p.host, p.path, arg_max(s.rule, length(s.rule)) AS rule, arg_max(s.verdict, length(s.rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) p JOIN split s
    ON (p.host = s.rule_host OR ends_with(p.host, '.' || s.rule_host)) AND starts_with(p.path, s.rule_path)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parsed p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""
