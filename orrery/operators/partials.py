"""User-defined aggregates that no column expression gives: init, update, merge, finish.

A task updates a state for each group from Arrow batches, so what is shuffled is a row of
numbers for each group and task, never the group's rows. States meet in two steps, first
within shares of the tasks, so that no step holds the states of all tasks of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..snapshot import Snapshot
from .expr import Property

#: Shares of the tasks in the first step of merging.
SHARES = 32


@dataclass(frozen=True)
class Partial:
    """``init()``: the state of no rows, numbers in an array. ``update(state, values, weights)``: with further rows; weights are 1 without a weight. ``merge(a, b)``: of both. ``finish(state)``: the result, a number, or an array with ``many``. Null and NaN values are left out. Updates and merges may come in any order."""

    init: Callable[[], np.ndarray]
    update: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], Any]
    many: bool = False

    @property
    def kind(self) -> str:
        return "array<double>" if self.many else "double"


#: Statistics of profiles by name.
PARTIALS: dict[str, Partial] = {}


def partial_statistic(name: str, partial: Partial) -> Partial:
    """Register a statistic: ``pr["mass"][name]``."""
    return PARTIALS.setdefault(name.lower(), partial)


def folded(rows: DataFrame, group: Column, value: Column, partial: Partial, weight: Column | None = None) -> DataFrame:
    """``g, value``: the result for each group (any numbers) that has values."""
    plain = rows.select(group.cast("long").alias("g"), value.cast("double").alias("v"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    init, update, merge, finish, many = partial.init, partial.update, partial.merge, partial.finish, partial.many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, np.ndarray] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch]).drop_null()
            g, v, w = (t[c].to_numpy() for c in "gvw")
            by = np.argsort(g[~np.isnan(v)], kind="stable")
            g, v, w = (x[~np.isnan(v)][by] for x in (g, v, w))
            start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
            for lo, hi in zip(start, np.append(start[1:], len(g)), strict=False):
                key = int(g[lo])
                states[key] = np.asarray(update(states.get(key, init()), v[lo:hi], w[lo:hi]), float)
        share = TaskContext.get().partitionId() % SHARES
        yield pa.RecordBatch.from_arrays([pa.array(list(states), pa.int64()), pa.array([share] * len(states), pa.int32()), pa.array(list(states.values()), pa.list_(pa.float64()))], names=["g", "share", "state"])

    def met(states: pd.DataFrame) -> np.ndarray:
        out, *rest = (np.array(s, float) for s in states["state"])
        for s in rest:
            out = np.asarray(merge(out, s), float)
        return out

    def first(states: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": states["g"].iloc[:1], "state": [met(states)]})

    def last(states: pd.DataFrame) -> pd.DataFrame:
        value = finish(met(states))
        return pd.DataFrame({"g": states["g"].iloc[:1], "value": [np.asarray(value, float) if many else float(value)]})

    ship(rows.sparkSession)
    states = plain.mapInArrow(run, "g long, share int, state array<double>")
    some = states.groupBy("g", "share").applyInPandas(first, "g long, state array<double>")
    return some.groupBy("g").applyInPandas(last, f"g long, value {partial.kind}")


@dataclass(eq=False)
class Folded(Property):
    """A user-defined aggregate of a field, as a calculator: NaN where there are no values."""

    partial: Partial
    parameter: str = "mass"
    weight: str | None = None

    def frame(self, snap: Snapshot) -> DataFrame:
        weight = None if self.weight is None else snap.field(self.weight)
        found = folded(snap.df, F.lit(0), snap.field(self.parameter), self.partial, weight).select("value")
        return found if self.partial.many else found.agg(F.coalesce(F.max("value"), F.lit(float("nan"))).alias("value"))


def _power_sums(state: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight, mean and central power sums up to the fourth."""
    n = w.sum()
    if not n:
        return state
    mean = (w * x).sum() / n
    d = x - mean
    return _merged_sums(state, np.array([n, mean, *((w * d**k).sum() for k in (2, 3, 4))]))


def _merged_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return b if not a[0] else a
    mean = (a[0] * a[1] + b[0] * b[1]) / n

    def about(s: np.ndarray) -> tuple[float, float, float]:
        d = s[1] - mean
        return s[2] + s[0] * d**2, s[3] + 3 * d * s[2] + s[0] * d**3, s[4] + 4 * d * s[3] + 6 * d**2 * s[2] + s[0] * d**4

    return np.array([n, mean, *(x + y for x, y in zip(about(a), about(b), strict=True))])


def _ratio(a: float, b: float) -> float:
    return a / b if b else float("nan")


partial_statistic("kurtosis", Partial(lambda: np.zeros(5), _power_sums, _merged_sums, lambda s: _ratio(s[0] * s[4], s[2] ** 2) - 3))
partial_statistic("skewness", Partial(lambda: np.zeros(5), _power_sums, _merged_sums, lambda s: _ratio(s[0] ** 0.5 * s[3], s[2] ** 1.5)))


def histogram(edges: list[float]) -> Partial:
    """Weights by interval, closed on the left; the last one on both sides. Values outside are left out."""
    e = np.asarray(edges, float)
    return Partial(lambda: np.zeros(len(e) - 1), lambda s, x, w: s + np.histogram(x, e, weights=w)[0], np.add, lambda s: s, many=True)
