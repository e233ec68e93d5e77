"""Running sums over an order of all rows, by ranges of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import partitions, stage

__all__ = ["running"]


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``df`` with the sums over all rows before each in ``order``, 0 for the first.

    Rows are dealt to tasks by ranges of ``order``, which has to tell all rows apart so that
    ranges can be even; they are staged, as both steps must see the same ranges. Windows run
    within ranges; each range goes on from the sums of those before it, a row a range.
    """
    dealt = df.select("*", *[c.alias(f"_add_{n}") for n, c in sums.items()]).repartitionByRange(partitions(df.sparkSession), *order)
    dealt = stage(dealt.withColumn("_range", F.spark_partition_id()), label)
    held = dealt.groupBy("_range").agg(*[F.sum(f"_add_{n}").alias(f"_held_{n}") for n in sums])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    held = held.select("_range", *[F.sum(f"_held_{n}").over(earlier).alias(f"_held_{n}") for n in sums])
    before = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = dealt.select("*", *[F.sum(f"_add_{n}").over(before).alias(f"_within_{n}") for n in sums])
    sum_of = lambda n: F.coalesce(f"_held_{n}", F.lit(0)) + F.coalesce(f"_within_{n}", F.lit(0))
    return within.join(F.broadcast(held), "_range").select(*df.columns, *[sum_of(n).alias(n) for n in sums])
