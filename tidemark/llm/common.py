"""Tables in, tables kept between steps, and connected components: what the operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words, apart from the space itself.
WORD_BREAKS = "\t\n\u000b\u000c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a temporary one is made,
    for a driver that is its own executor only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends there, and losing executors loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dealt_by(df: DataFrame, column: str) -> DataFrame:
    """``df`` shuffled by a column into as many partitions as keep_by() makes buckets."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def keep_by(df: DataFrame, column: str) -> DataFrame:
    """The same as keep(), bucketed by a column: joins and groupings by it find the table's rows where they are.

    ``df`` should come from dealt_by(), so that each bucket is one file.
    """
    spark = df.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.kept_at, out.kept_as = path, name
    return out


def discard(*kept: DataFrame) -> None:
    """Deletes tables that keep() or keep_by() wrote, once nothing reads them any more."""
    for df in kept:
        if hasattr(df, "kept_as"):
            df.sparkSession.sql(f"DROP TABLE {df.kept_as}")
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of ``counts`` with the largest values of the column ``n``: as many as fit into ``most`` rows, ties together.

    The least value comes from a histogram over values with three digits, so no task and no driver sorts rows. Where the
    highest values alone are more than ``most`` rows, a hash of the rows picks ``most`` of them.
    """
    value = F.col(n).cast("double")
    step = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.greatest(value, F.lit(1e-300)))) - 2, F.lit(-300)))
    rounded = counts.withColumn("_least", F.when(value > 0, F.floor(value / step) * step).otherwise(0.0))
    bins = sorted(rounded.groupBy("_least").agg(F.count("*").alias("rows")).collect(), reverse=True)
    total, least = 0, float("inf")
    for low, rows in bins:
        total += rows
        if total > most:
            break
        least = low
    if least == float("inf") and bins:
        # at most ``most`` rows come together, the least hashes of each task's
        return rounded.where(F.col("_least") >= bins[0][0]).drop("_least").orderBy(F.xxhash64(*counts.columns), *counts.columns).limit(most)
    return rounded.where(F.col("_least") >= least).drop("_least")


def where_likely(df: DataFrame, keys: DataFrame, column: str, words: int = 1 << 19) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among ``keys``: all that are, and few others while keys are far fewer than bits.

    The keys' hashes set bits of at most ``words`` numbers of 64 bits, so what is broadcast stays bounded at any size, and
    rows that a later join would drop are not shuffled for it.
    """
    place = F.pmod(F.xxhash64(F.lit(64), F.col(column)), F.lit(words * 64))
    bits = keys.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 as int))")).alias("_bits")
    )
    placed = df.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6))
    return placed.join(F.broadcast(bits), "_word").where(F.getbit("_bits", F.expr("cast(_place & 63 as int)")) == 1).select(df.columns)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_array(text: str | Column = "text") -> Column:
    """The words of a text: maximal runs outside ``[\\x20\\x09-\\x0D]``."""
    spaced = F.translate(text_or_empty(text), WORD_BREAKS, " " * len(WORD_BREAKS))
    return F.array_remove(F.split(spaced, " "), "")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value written as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node, component being the smallest node.

    Each round links every node's neighbours to the smallest node it sees, first those larger than the node, then
    the others, so that paths shrink to stars in about log(length) rounds; a hub's edges are combined before they
    are shuffled. Rounds end when the edges no longer change.
    """
    pairs = keep(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    before = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct()
        )
        larger, pairs = pairs, keep(small)
        discard(larger)
        after = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
