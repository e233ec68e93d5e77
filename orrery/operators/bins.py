"""One-dimensional bins. Intervals are closed on the right; a value at the first edge is in the first bin, values outside and NaN are in none."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.core import Calculator
from ..snapshot import Snapshot
from ..units import in_units
from .quantiles import Rank, ranked

BINS_BY: dict[str, Callable[[Snapshot], Column]] = {}
ALGORITHMS: dict[str, Callable[..., np.ndarray]] = {}
AREAS: dict[str, Callable[..., np.ndarray]] = {}


def bins_by_register(name: str):
    return lambda fn: BINS_BY.setdefault(name, fn)


def bins_algorithm_register(name: str):
    return lambda fn: ALGORITHMS.setdefault(name, fn)


def bins_area_register(name: str):
    return lambda fn: AREAS.setdefault(name, fn)


def available_options() -> dict[str, list[str]]:
    return {"bins_by": sorted(BINS_BY), "bins_type": sorted(ALGORITHMS), "bins_area": sorted(AREAS)}


@bins_algorithm_register("lin")
def lin(df: DataFrame, low: float, high: float, nbins: int) -> np.ndarray:
    return np.linspace(low, high, nbins + 1)


@bins_algorithm_register("log")
def log(df: DataFrame, low: float, high: float, nbins: int) -> np.ndarray:
    if low <= 0:
        raise ValueError("bins by logarithm start above 0")
    edges = np.logspace(math.log10(low), math.log10(high), nbins + 1)
    edges[0], edges[-1] = low, high  # powers of logarithms may miss the ends by a last place
    return edges


@bins_algorithm_register("equaln")
def equaln(df: DataFrame, low: float, high: float, nbins: int) -> np.ndarray:
    """Edges at ranks i n / nbins, exactly: two passes of ``ranked`` for all of them."""
    rows = df.where((F.col("_key") >= low) & (F.col("_key") <= high))
    wanted = [Rank(0, of=i, parts=nbins) for i in range(nbins + 1)]
    found = {r["i"]: r["at"] for r in ranked(rows, F.lit(0), [F.col("_key")], wanted, linear=False).collect()}
    if len(found) < nbins + 1 or rows.limit(2).count() < 2:
        raise ValueError("bins of equal number need two values in range")
    return np.array([found[i] for i in range(nbins + 1)])


bins_area_register("length")(lambda e, **_: np.diff(e))
bins_area_register("annulus")(lambda e, **_: math.pi * np.diff(e**2))
bins_area_register("spherical_shell")(lambda e, **_: 4 / 3 * math.pi * np.diff(e**3))


@bins_area_register("cylindrical_shell")
def _cylindrical(e: np.ndarray, z: float | None = None, **_: Any) -> np.ndarray:
    if z is None:
        raise ValueError("bins of cylindrical shells need z")
    return math.pi * np.diff(e**2) * z


@dataclass(frozen=True)
class Edges:
    """Bins that are made: a few numbers on the driver."""

    edges: np.ndarray
    size: np.ndarray
    even: bool = False

    @property
    def nbins(self) -> int:
        return len(self.edges) - 1

    @property
    def centers(self) -> np.ndarray:
        return 0.5 * (self.edges[1:] + self.edges[:-1])

    @property
    def dr(self) -> np.ndarray:
        return np.gradient(self.centers) if self.nbins > 1 else np.diff(self.edges)

    def assign(self, x: Column) -> Column:
        """The bin of a value, from 0; null outside. Even bins start from the closed form and look at the edges beside it, so that both ways agree to the last place."""
        e, n = [float(v) for v in self.edges], self.nbins
        table = F.array(*[F.lit(v) for v in e])
        if self.even and e[-1] > e[0]:
            guess = F.greatest(F.least(F.floor((x - e[0]) / ((e[-1] - e[0]) / n)), F.lit(n - 1)), F.lit(0)).cast("int")
            bin_ = F.when(F.get(table, guess) >= x, guess - 1).when(F.get(table, guess + 1) < x, guess + 1).otherwise(guess)
        else:
            bin_ = F.size(F.filter(table, lambda v: v < x)) - 1
        return F.when((x >= e[0]) & (x <= e[-1]) & ~F.isnan(x), F.when(x == e[-1], n - 1).when(x == e[0], 0).otherwise(bin_))

    def table(self, spark) -> DataFrame:
        """``bin, left, right, center, dr, size``: a row for each bin."""
        rows = ", ".join(f"({i}, {a!r}D, {b!r}D, {c!r}D, {d!r}D, {s!r}D)" for i, (a, b, c, d, s) in enumerate(zip(*(map(float, v) for v in (self.edges[:-1], self.edges[1:], self.centers, self.dr, self.size)), strict=True)))
        return spark.sql(f"SELECT * FROM VALUES {rows} AS t(bin, left, right, center, dr, size)")


@dataclass(frozen=True)
class BinsSet:
    bins_by: Any = "r"
    bins_area: Any = "spherical_shell"
    bins_type: Any = "lin"
    nbins: int = 100
    bin_min: Any = None
    bin_max: Any = None
    options: tuple[tuple[str, Any], ...] = ()

    def key(self, snap: Snapshot) -> Column:
        if callable(self.bins_by):
            return self.bins_by(snap)
        return BINS_BY[self.bins_by](snap) if self.bins_by in BINS_BY else snap.field(self.bins_by)

    def _bound(self, v: Any, snap: Snapshot) -> float | None:
        if v is None:
            return None
        if isinstance(v, Calculator) or callable(v):
            v = v(snap)
        return in_units(v, snap.unit_of(self.bins_by) if isinstance(self.bins_by, str) else None)

    def __call__(self, snap: Snapshot) -> Edges:
        if not isinstance(self.bins_type, str) and not callable(self.bins_type):
            edges = np.asarray(self.bins_type, float)
            if edges.ndim != 1 or len(edges) < 2:
                raise ValueError("edges are one row of two numbers or more")
        else:
            low, high = self._bound(self.bin_min, snap), self._bound(self.bin_max, snap)
            rows = snap.df.select(self.key(snap).cast("double").alias("_key")).where("_key is not null and not isnan(_key)")
            if low is None or high is None:
                a, b = rows.agg(F.min("_key"), F.max("_key")).first()
                if a is None:
                    raise ValueError("no values to make bins of")
                low, high = a if low is None else low, b if high is None else high
            make = self.bins_type if callable(self.bins_type) else ALGORITHMS.get(self.bins_type)
            if make is None:
                raise ValueError(f"bins_type {self.bins_type!r} is none of {sorted(ALGORITHMS)}")
            edges = np.asarray(make(rows, low, high, self.nbins), float)
        area = self.bins_area if callable(self.bins_area) else AREAS.get(self.bins_area)
        if area is None:
            raise ValueError(f"bins_area {self.bins_area!r} is none of {sorted(AREAS)}")
        return Edges(edges, area(edges, **dict(self.options)), self.bins_type == "lin" if isinstance(self.bins_type, str) else False)


def as_edges(edges: Sequence[float]) -> BinsSet:
    return BinsSet(bins_type=tuple(edges), bins_area="length")
