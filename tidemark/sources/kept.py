"""Tables between steps, written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..streaming.jobs import shared_dir


def keep(df: DataFrame) -> DataFrame:
    """Writes a frame and reads it back: lineage ends there, and losing executors loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = file_system(spark, path)
    return fs.exists(place)


def discard(*kept: DataFrame) -> None:
    """Deletes tables that keep() wrote, once nothing reads them any more."""
    for df in kept:
        place, fs = file_system(df.sparkSession, df.kept_at)
        fs.delete(place, True)
