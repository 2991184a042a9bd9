"""Row numbers and running sums over a whole table or large groups, without a task that sees a whole group.

Rows are range-partitioned by group and order and summed up within each part; of a part only its first group may have begun
before it, so one number per part, carried from part to part, makes the sums those of whole groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.kept import keep


def running(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), weight: Column | None = None, name: str = "before") -> DataFrame:
    """Adds the sum of ``weight`` (whole numbers, 1 by default) of the group's rows before each one in order. Null groups are
    groups; rows that are equal in order stand in any order, so the order should be whole."""
    marked = df.withColumn("_g", F.xxhash64(*group) if group else F.lit(0).cast("long")).withColumn("_w", (F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))).cast("long"))
    by = [*[F.col(c) for c in group], *order]
    names = marked.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in marked.dtypes) + ", _before long, _first boolean, _i long, _part int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, total, seen = TaskContext.get().partitionId(), None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g, w = batch.column("_g").to_numpy(), batch.column("_w").to_numpy()
            first = g[0] if first is None else first
            new = np.append(g[0] != last, g[1:] != g[:-1])
            before = np.cumsum(w) - w
            starts = np.flatnonzero(new)
            base = np.zeros(len(g), dtype=np.int64)
            base[starts] = np.diff(before[starts], prepend=0)
            before = before - np.cumsum(base)
            before[: starts[0] if len(starts) else len(g)] += total
            last, total = g[-1], int(before[-1] + w[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before), pa.array(g == first), pa.array(np.arange(seen, seen + len(g))), pa.array(np.full(len(g), part), pa.int32())], names=[*names, "_before", "_first", "_i", "_part"])
            seen += len(g)

    kept = keep(marked.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema))
    ends = kept.groupBy("_part").agg(
        F.min_by("_g", "_i").alias("first"), F.max_by("_g", "_i").alias("last"), F.max_by(F.col("_before") + F.col("_w"), "_i").alias("total"))
    offsets, at, carried = [], None, 0
    for r in sorted(ends.collect()):  # one row a part
        offset = carried if r["first"] == at else 0
        offsets.append((r["_part"], offset))
        at, carried = r["last"], r["total"] + (offset if r["first"] == r["last"] else 0)
    sums = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    whole = F.col("_before") + F.when(F.col("_first"), F.col("_offset")).otherwise(0)
    return kept.join(F.broadcast(sums), "_part").select(*[F.col(c) for c in df.columns], whole.alias(name))


def numbered(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "place") -> DataFrame:
    """Adds each row's number in its group, from 1."""
    return running(df, order, group, None, name).withColumn(name, F.col(name) + 1)
