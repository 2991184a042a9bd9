"""Host-level quality rules: failures summed by host, rates shrunk by an empirical beta prior, verdicts joined back.

Only DataFrame functions are used. A document fails the base rules if it has too few words or too large a share of
its words in repeated windows of eight. Per host (the ``source`` column) failures and documents are counted; a beta
prior fitted by moments to the hosts' rates pulls the rates of small hosts towards the common rate; a host whose
shrunken rate exceeds ``MAX_HOST_RATE`` has all its documents rejected.

Null texts and texts of blanks have no words and fail. A null source is a host of its own. Repeated rows count and
are judged one by one. An empty table gives an empty result. With fewer than two hosts, or where all hosts have one
rate, the prior is the common rate with the weight of ``FLAT_PRIOR`` documents.

Equal windows are found by 64-bit hashes of their words' hashes, within one text each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, keep, table, text_or_empty, word_array, WORD_BREAKS

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_HOST_RATE = 0.5
FLAT_PRIOR = 10.0
SYMBOLS = "#*$%&|<>"


def measure(docs: DataFrame, *keys: str) -> DataFrame:
    """The base measures of each row of ``docs``, beside the columns ``keys``."""
    text = text_or_empty("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " " + WORD_BREAKS, "") != "")
    base = docs.select(
        *keys,
        F.length(F.translate(text, " " + WORD_BREAKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform(word_array("text"), lambda w: F.xxhash64(w)).alias("_words"),
    )
    counted = base.select(
        *keys, "word_chars", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_words") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
        ).alias("_windows"),
    )
    numbers = [*keys, "word_chars", "n_symbols", "n_words", "n_dup_lines"]
    # sorted by hash, equal windows stand side by side; only texts that have any are sorted
    ordered = counted.select(
        *numbers,
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    s = F.col("_sorted")
    same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
    placed = ordered.select(
        *numbers,
        F.sort_array(F.transform(
            F.filter(s, lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False))),
            lambda x: x["i"],
        )).alias("_at"),
    )
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return placed.select(*numbers, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "base_failed", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: host, host_docs, host_failures, host_rate (shrunken), host_ok."""
    hosts = judged.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failures"))
    # moments of the hosts' rates; the binomial share of their variance is taken off before the prior is fitted
    rate = F.col("host_failures") / F.col("host_docs")
    sums = hosts.agg(
        F.sum("host_docs").alias("docs"), F.sum("host_failures").alias("failures"), F.count("*").alias("hosts"),
        F.sum(F.lit(1.0) / F.col("host_docs")).alias("inverse"), F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"),
    )
    mean = (F.col("failures") / F.col("docs"))
    binomial = mean * (1 - mean) * F.col("inverse") / F.col("hosts")
    between = F.col("spread") - binomial
    weight = F.when((F.col("hosts") > 1) & (between > 0) & (mean > 0) & (mean < 1),
                    F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0))).otherwise(F.lit(FLAT_PRIOR))
    prior = sums.select(mean.alias("prior_mean"), F.least(weight, F.lit(1e6)).alias("prior_weight"))
    shrunk = (F.col("host_failures") + F.col("prior_mean") * F.col("prior_weight")) / (F.col("host_docs") + F.col("prior_weight"))
    # the prior is one row, so this join adds two numbers to each host
    return hosts.join(F.broadcast(prior)).select(
        host, "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk <= max_rate).alias("host_ok")
    )


def judge_documents(docs: DataFrame, *keys: str) -> DataFrame:
    """Measures, base_failed and kept of each row, beside ``keys`` and source."""
    # the measures cost far more than they weigh, and both the host totals and the verdicts need them
    measured = keep(measure(docs, *keys, "source").withColumn("base_failed", base_failed()))
    hosts = host_verdicts(measured).select(F.col("source").alias("_host"), "host_ok")
    return measured.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))
    ).drop("_host", "host_ok")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules and their host's verdict let pass, with all their columns."""
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text", "source"))
    kept = judge_documents(keyed.select("text", "source", row), row).where("kept").select(row).distinct()
    return keyed.join(kept, row, "left_semi").drop(row)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


MEASURES_SQL = r"""
texts AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM texts)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (
  SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM again) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT t.doc_id, t.source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM texts t LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS docs, sum(base_failed::INT) AS failures FROM judged GROUP BY source),
moments AS (
  SELECT sum(failures) / sum(docs) AS mean, count(*) AS hosts, var_pop(failures / docs) AS spread, sum(1.0 / docs) AS inverse FROM hosts),
prior AS (
  SELECT mean, least(CASE WHEN hosts > 1 AND spread - mean * (1 - mean) * inverse / hosts > 0 AND mean > 0 AND mean < 1
    THEN greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * inverse / hosts) - 1, 1.0) ELSE 10.0 END, 1e6) AS weight FROM moments),
passed AS (SELECT source, (failures + mean * weight) / (docs + weight) <= 0.5 AS host_ok FROM hosts, prior)
"""

ORACLE = f"""
WITH {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_ok, true) AS kept
FROM judged j LEFT JOIN passed p ON j.source IS NOT DISTINCT FROM p.source
"""
