"""Daily quotas: calls are let through in order as long as those let through before leave room."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The day of a quota begins at midnight at UTC+8.
ZONE = "INTERVAL 8 HOURS"


def quota_day(ts: Column) -> Column:
    return F.to_date(ts + F.expr(ZONE))


def admitted(calls: DataFrame, limit: int, user: str = "user_id", ts: str = "ts", key: str = "call_id", cost: str = "cost") -> DataFrame:
    """Adds day, admitted and used (what the day's admitted calls cost so far, this one included).

    A call is admitted if its cost and those admitted before it on its user's day stay within ``limit``; one that is turned away
    uses nothing, so a later, smaller one may still come through. That is a fold in order (time, then key), not a running
    sum. Rows of a user and day are neighbours of one sorted partition and stream through with one number of state, so a
    day of any length takes no memory; different days and users of a task follow each other.

    Costs that are null or below 0 count as 0. Calls without a user share one; calls without time are turned away.
    """
    cost_ = F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(0)), F.lit(0)).alias("_cost")
    rows = calls.select("*", quota_day(F.col(ts)).alias("day"), cost_)
    sorted_ = rows.repartition(user, "day").sortWithinPartitions(user, "day", ts, key)
    names = [*calls.columns, "day"]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_cost").dtypes) + ", admitted boolean, used long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used = None, 0
        for batch in batches:
            let, so_far = [], []
            for who, day, price in zip(batch.column(user).to_pylist(), batch.column("day").to_pylist(), batch.column("_cost").to_pylist()):
                if (who, day) != group:
                    group, used = (who, day), 0
                fits = day is not None and used + price <= limit
                used += price if fits else 0
                let.append(fits)
                so_far.append(used)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(let, pa.bool_()), pa.array(so_far, pa.int64())], names=[*names, "admitted", "used"])

    return sorted_.mapInArrow(run, schema)


def day_usage(calls: DataFrame, limit: int, user: str = "user_id", **names: str) -> DataFrame:
    """Per user and day: what was used of the limit, how much is left, how many calls were let through and turned away."""
    marked = admitted(calls, limit, user, **names).where("day IS NOT NULL")
    return marked.groupBy(user, "day").agg(F.max("used").alias("used"), F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused")).withColumn("left", F.lit(limit) - F.col("used"))
