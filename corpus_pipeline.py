"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``; the last returns one row per document that is left,
with its rate, copies and words taken.

1. quality_rules: documents that fail the base rules, or whose host's shrunken failure rate is too high, go.
2. jaccard_join: of each group of near copies (five words, similarity 0.8) the document with the smallest id stays.
3. suffix_dedup: bytes in strings of 200 bytes that start elsewhere too are taken out of the texts.
4. decontamination: documents in which a benchmark item has leaked go.
5. mixing: sources are mixed to their target words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep, table
from tidemark.llm.decontamination import drop_leaks
from tidemark.llm.jaccard_join import keep_one
from tidemark.llm.mixing import mix
from tidemark.llm.quality_rules import keep_good
from tidemark.llm.suffix_dedup import drop_repeats

NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, percent=NEAR_PERCENT, size=NEAR_WORDS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = drop_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express the near copies, the repeated bytes and the mix within reason; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
