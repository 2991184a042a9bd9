"""Walking back through history: windows from now to a last day, each one converted, written and then marked as done.

Windows follow each other backward in time. Each one also takes in a stretch of the window behind it (later in time), since
rows of it may have come in after that window was done; what has been written before is left out by its item's id. A
window's rows are written before its mark, so a walk that dies in one does this window again when it is started again, and
each row is there once.

Rows (platform, payload, at) without a time or of a platform without a converter are left out, as are payloads that give no
item. Of several payloads of an item in one window the last one counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kept import exists
from .payloads import CONVERTERS, ITEM


def windows(now: datetime, until: datetime, window: timedelta) -> Iterator[tuple[datetime, datetime]]:
    """(begin, end] of each window, the newest first."""
    end = now
    while end > until:
        yield max(end - window, until), end
        end -= window


def _folder(folder: str, n: int) -> str:
    return f"{folder}/items/window={n}"


def finished(spark: SparkSession, folder: str) -> int:
    n = 0
    while exists(spark, f"{_folder(folder, n)}/_SUCCESS"):
        n += 1
    return n


def items(spark: SparkSession, folder: str, windows_done: int | None = None) -> DataFrame:
    """What the finished windows have given, with each window's number."""
    n = finished(spark, folder) if windows_done is None else windows_done
    if not n:
        return spark.createDataFrame([], f"{ITEM}, window int")
    return spark.read.schema(f"{ITEM}, window int").option("basePath", f"{folder}/items").parquet(*[_folder(folder, i) for i in range(n)])


def converted(rows: DataFrame) -> DataFrame:
    """The items of rows of several platforms."""
    each = [convert(rows.where(F.col("platform") == name).select("payload")) for name, convert in CONVERTERS.items()]
    return reduce(DataFrame.unionByName, each)


def walk_back(history: DataFrame, folder: str, now: datetime, until: datetime, window: timedelta, overlap: timedelta) -> Iterator[tuple[datetime, datetime]]:
    """Works off one window after the other, from the first that is not done; gives each one's bounds when it is. The walk must be
    started again with the same bounds."""
    spark = history.sparkSession
    for n, (begin, end) in enumerate(windows(now, until, window)):
        if n < finished(spark, folder):
            continue
        rows = history.where((F.col("at") > F.lit(begin)) & (F.col("at") <= F.lit(min(end + overlap, now))))
        newest = F.max_by(F.struct(*[c.split()[0] for c in ITEM.split(", ")[1:]]), F.struct(F.col("published_at"), "title"))
        new = converted(rows).where("item_id IS NOT NULL").groupBy("item_id").agg(newest.alias("s")).select("item_id", "s.*")
        new.join(items(spark, folder, n).select("item_id"), "item_id", "left_anti").write.mode("overwrite").parquet(_folder(folder, n))
        yield begin, end
