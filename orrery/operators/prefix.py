"""Prefix sums over a whole table, of which only a small part is ever sorted.

Rows are summed in buckets of even width of the key: plain arithmetic, one partial sum a task.
The sums tell in which bucket a wanted prefix sum is reached, and only that bucket's rows are
put in order; a bucket that holds too many still is cut again, a pass each time, so uneven keys
cost passes and no large tasks. Rows of equal key are summed before they are ordered, so a
frequent key is one row. Ends and sums of buckets are a few numbers on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: Buckets of more rows are cut again before one task orders them.
ORDERED = 5_000_000


@dataclass(frozen=True)
class Bucket:
    """Rows with ``least <= k <= most``, what they sum to, what those before sum to, and the last key before."""

    n: int
    total: float
    least: float
    most: float
    base: float = 0.0
    before: float | None = None

    def holds(self, k: Column) -> Column:
        return (k >= self.least) & (k <= self.most)


def bucket_of(k: Column, low: Column | float, high: Column | float, buckets: int = BUCKETS) -> Column:
    """The bucket of a value, from 0. It never falls as ``k`` grows, so buckets are intervals whatever the rounding."""
    low, high = (F.lit(x) if not isinstance(x, Column) else x for x in (low, high))
    at = F.floor((k - low) / (high - low) * buckets)
    return F.when((high > low) & (high - low < float("inf")), F.greatest(F.least(at, F.lit(buckets - 1)), F.lit(0))).otherwise(0).cast("int")


def keyed(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``k, w``. Rows of null or NaN key are left out."""
    return df.select(key.cast("double").alias("k"), value.cast("double").alias("w")).where("k is not null and not isnan(k)")


def cut(rows: DataFrame, of: Bucket | None = None) -> tuple[list[Bucket], float]:
    """The buckets of the rows (or those of one bucket), in order, and the value of the first row (of all rows)."""
    first, base, before = 0.0, 0.0, None  # of one bucket, the first is not asked for
    if of is None:
        low, high = rows.agg(F.min("k"), F.max("k")).first()
        if low is None:
            return [], 0.0
    else:
        low, high, base, before = of.least, of.most, of.base, of.before
        rows = rows.where(of.holds(F.col("k")))
    found = rows.groupBy(bucket_of(F.col("k"), low, high).alias("b")).agg(F.count("*"), F.sum("w"), F.min("k"), F.max("k"), F.min(F.when(F.col("k") == low, F.col("w")))).collect()
    out = []
    for _, n, total, least, most, start in sorted(found, key=lambda r: r[0]):
        first = start if start is not None else first
        out.append(Bucket(n, total or 0.0, least, most, base, before))
        base, before = base + (total or 0.0), most
    return out, first


def narrowed(rows: DataFrame, buckets: list[Bucket], wanted: Callable[[Bucket], bool]) -> list[Bucket]:
    """The buckets that are wanted, cut until each can be put in order."""
    out = []
    for b in buckets:
        if wanted(b):
            out += narrowed(rows, cut(rows, b)[0], wanted) if b.n > ORDERED and b.least < b.most < float("inf") and b.least > float("-inf") else [b]
    return out


def reaching(target: float) -> Callable[[Bucket], bool]:
    """Whether the prefix sum reaches the target in the bucket; a little more, for the last places of sums."""
    return lambda b: b.base - 1e-9 * abs(b.base) <= target <= (b.base + b.total) + 1e-9 * abs(b.base + b.total)


def ordered(rows: DataFrame, buckets: list[Bucket]) -> DataFrame:
    """``k, first, c0, c, k0``: of each key in the buckets, the least value, the sums before it and with it, and the key before."""
    buckets = list(dict.fromkeys(buckets))
    of = F.coalesce(*[F.when(b.holds(F.col("k")), i) for i, b in enumerate(buckets)]) if buckets else F.lit(None).cast("int")
    keys = rows.select("k", "w", of.alias("b")).where("b is not null").groupBy("b", "k").agg(F.min("w").alias("first"), F.sum("w").alias("t"))
    in_order = Window.partitionBy("b").orderBy("k")
    pick = lambda values: F.get(F.array(*[F.lit(v).cast("double") for v in values] or [F.lit(None).cast("double")]), F.col("b"))
    upto = F.sum("t").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) + pick([b.base for b in buckets])
    last = F.coalesce(F.lag("k").over(in_order), pick([b.before for b in buckets]))
    return keys.select("k", "first", (upto - F.col("t")).alias("c0"), upto.alias("c"), last.alias("k0"))


def crossing(target: float, linear: bool = True) -> Column:
    """Aggregate over ``ordered``: the key at which the sum reaches the target; linear between the row before and the one that reaches it."""
    step = F.col("k") - F.col("k0")
    between = F.col("k0") + step * ((F.lit(target) - F.col("c0")) / F.col("first"))
    value = F.when(F.col("k0").isNotNull() & (F.col("c0") + F.col("first") >= target) & (F.col("first") > 0), between).otherwise(F.col("k")) if linear else F.col("k")
    return F.min(F.when(F.col("c") >= target, F.struct(F.col("k"), value.alias("at"))))["at"]


def whole(buckets: list[Bucket]) -> float:
    return buckets[-1].base + buckets[-1].total if buckets else 0.0


__all__ = ["Bucket", "bucket_of", "crossing", "cut", "keyed", "narrowed", "ordered", "reaching", "whole"]
