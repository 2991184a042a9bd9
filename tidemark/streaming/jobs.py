"""Event streams: late duplicates, tumbling days, newest rows per key, status folds and source health.

Streams read folders of Parquet files. ``run_once`` works off what is there and returns the table that it wrote, so
batch queries and tests see a finished result; on a cluster the same frames go to ``writeStream`` with a trigger.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Overlap of two fetches of a source; duplicates that come within it are dropped.
OVERLAP = "30 minutes"
#: How late retried items may come.
LATE = "72 hours"
BROKEN_AFTER = 3


def source(spark: SparkSession, path: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream of the rows of one Parquet table, a file or a folder of files; its time column as timestamp with zone,
    as watermarks ask for."""
    at = f"{path}/{name}.parquet"
    rows = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(at)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        rows = rows.parquet(at)
    else:  # streams read folders; the filter leaves one file of it
        rows = rows.option("pathGlobFilter", f"{name}.parquet").parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where that is unset and the driver is its own executor."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tidemark-stream-")


def run_once(stream: DataFrame, mode: str = "append", keys: Sequence[str] = (), folder: str | None = None) -> DataFrame:
    """Works off what the stream has and returns the rows written.

    In update mode each batch's changed rows are written under its number, and the last one of each key counts; a batch
    that is run again after a failure overwrites its own rows. Files and state go to ``folder``, by default a new one in
    the shared folder; called again with the same folder, it goes on from where it was.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    rows = spark.read.schema(f"{fields}, batch long").parquet(f"{folder}/rows")
    others = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col("_last")[c].alias(c) for c in stream.columns])


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.withWatermark("ts", OVERLAP).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Tumbling days; rows later than LATE are left out."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", LATE).groupBy(day, key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("window.start").alias("day"), key, "n", "total")


def newest_per_key(events: DataFrame, key: str = "user_id", number: str = "event_id") -> DataFrame:
    """High watermark of each key; a key without rows has none, so all its rows are new."""
    return events.groupBy(key).agg(F.max(number).alias("newest"), F.max("ts").alias("last_at"))


def status_fold(events: DataFrame) -> DataFrame:
    """Per user: stars toggled by purchases, newest click."""
    return events.groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "purchase") % 2 == 1).alias("starred"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("clicked_at"))


def source_health(events: DataFrame) -> DataFrame:
    """Failures in a row of each user's stream, and the longest such run: state carried from batch to batch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, longest = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for bad in rows["event_type"] == "error":
            now = now + 1 if bad else 0
            longest = max(longest, now)
        state.update((int(now), int(longest)))
        yield pd.DataFrame({"user_id": [key[0]], "in_a_row": [now], "longest": [longest], "broken": [longest >= BROKEN_AFTER]})

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, in_a_row long, longest long, broken boolean", "now long, longest long", "update", GroupStateTimeout.NoTimeout)
