"""Arithmetic as floating-point hardware does it: ANSI mode raises on x / 0, which is +-inf or NaN here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def divide(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b != 0, a / b).when(b.isNull(), None).otherwise(at_zero)


def clip(c: Column, low: Column | None, high: Column | None) -> Column:
    """NaN stays NaN, which Spark orders above every number."""
    out = c
    if low is not None:
        out = F.greatest(out, low)
    if high is not None:
        out = F.least(out, high)
    return F.when(F.isnan(c), NAN).otherwise(out)


def root(c: Column) -> Column:
    return F.sqrt(c)
