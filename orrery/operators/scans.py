"""Scans over all rows in order: no task and no window holds more than a range of them.

Rows are dealt to tasks by ranges of their keys and put in order there. Each range says what
it sums to, a few numbers a range on the driver, and each task then goes on from the sum of
the ranges before its own. Ranges come from a sample, so the dealt rows are persisted: a
second deal might cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: The places within a partition that ``monotonically_increasing_id`` can count.
IN_PART = 2**33


def dealt(df: DataFrame, *order: str) -> DataFrame:
    """The rows in ranges of ``order``, in order within each, persisted. A frequent first key is divided by the columns after it."""
    columns = [F.col(c).asc_nulls_first() for c in order]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns).persist()


def place(held: dict[int, int]) -> Column:
    """Each row's place, from the numbers of rows by partition."""
    n = max(held, default=-1) + 1
    before = list(accumulate((held.get(i, 0) for i in range(n)), initial=0))[:-1]
    first = F.expr("get(cast(array({}) as array<bigint>), spark_partition_id())".format(", ".join(f"{b}L" for b in before)))
    return (first + F.monotonically_increasing_id() % IN_PART).cast("long")


def running_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each, by ``key``, in ``out``. Nulls count as 0."""
    rows = dealt(df.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0))), key)
    sums = {r["part"]: r["t"] for r in rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(value).alias("t")).collect()}
    before = list(accumulate((sums.get(i, 0.0) for i in range(max(sums, default=-1) + 1)), initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base = before[part] if part < len(before) else 0.0
        for batch in batches:
            total = base + np.cumsum(batch.column(value).to_numpy())
            base = float(total[-1]) if len(total) else base
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*batch.schema.names, out])

    ship(df.sparkSession)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def first_crossing(steps: DataFrame, start: float, find: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], float | None]) -> float | None:
    """``steps``: ``r, late, d``, what is added at each place, a row for each; at the same place those of lesser ``late`` come first. ``find(r, was, held, next)`` gives the least crossing of a stretch of places in order, from what is held before and from each and the place that follows (NaN: none). The least of all."""
    rows = dealt(steps, "r", "late")
    try:
        parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("d").alias("t"), F.min("r").alias("r")).orderBy("part").collect()
        before, after, base = {}, {}, start
        for p, later in zip(parts, [*(x["r"] for x in parts[1:]), float("nan")], strict=True):
            before[p["part"]], after[p["part"]] = base, later
            base += p["t"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            held, last_r, last = before.get(part), None, None
            found = []

            def look(r: np.ndarray, d: np.ndarray, was: float) -> float:
                """A stretch whose last place has no next one yet waits for it; the places before are looked at."""
                sums = was + np.cumsum(d)
                got = find(r[:-1], np.concatenate([[was], sums[:-2]]), sums[:-1], r[1:]) if len(r) > 1 else None
                if got is not None:
                    found.append(got)
                return float(sums[-2]) if len(r) > 1 else was

            for batch in batches:
                r, d = batch.column("r").to_numpy(), batch.column("d").to_numpy()
                if last_r is not None:
                    r, d = np.append(last_r, r), np.append(last, d)
                if len(r):
                    held = look(r, d, held)
                    last_r, last = r[-1], d[-1]
            if last_r is not None:
                look(np.array([last_r, after[part]]), np.array([last, 0.0]), held)
            yield pa.RecordBatch.from_arrays([pa.array([min(found)] if found else [], pa.float64())], names=["at"])

        ship(steps.sparkSession)
        return rows.select("r", "d").mapInArrow(run, "at double").agg(F.min("at")).first()[0]
    finally:
        rows.unpersist()
