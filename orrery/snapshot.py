"""A snapshot: a lazy table of particles, the units of its fields, and its properties."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import ALIASES, DERIVED, UnitColumn, resolve
from .functions.quantities import text_of
from .units import Unit

FAMILIES = {"dm": "dm", "d": "dm", "dark": "dm", "gas": "gas", "g": "gas", "star": "star", "s": "star", "st": "star", "stars": "star"}
#: Dimensions of derived fields in terms of stored ones: (field, power).
_UNITS_OF = {"r": (("pos", 1),), "rxy": (("pos", 1),), "r2": (("pos", 2),), "rxy2": (("pos", 2),), "v": (("vel", 1),), "v2": (("vel", 2),), "ke": (("vel", 2),), "vr": (("vel", 1),), "vcxy": (("vel", 1),), "vphi": (("vel", 1),), "vtheta": (("vel", 1),), "vrxy": (("vel", 1),), "jz": (("pos", 1), ("vel", 1))}


def family_name(name: str) -> str:
    if not isinstance(name, str) or name.lower() not in FAMILIES:
        raise ValueError(f"{name!r} is no family: {sorted(FAMILIES)}")
    return FAMILIES[name.lower()]


class Quantity(NamedTuple):
    value: float
    unit: Unit | None

    def in_units(self, unit: str | Unit) -> float:
        return self.value if self.unit is None else self.value * self.unit.ratio(unit)


#: Reduction: the power of the field's unit, and the aggregate.
REDUCTIONS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "min": (1, F.min), "max": (1, F.max), "sum": (1, F.sum), "mean": (1, F.avg), "std": (1, F.stddev_pop), "var": (2, F.var_pop), "median": (1, F.count),
    "count": (0, F.count), "ptp": (1, lambda x: F.max(x) - F.min(x)),
}


@dataclass(frozen=True)
class Snapshot:
    """``order``: columns that order rows of equal key, for results that do not depend on partitions."""

    df: DataFrame
    units: Mapping[str, str] = field(default_factory=dict)
    properties: Mapping[str, float] = field(default_factory=dict)
    order: tuple[str, ...] = ("pid",)

    def field(self, name: str) -> Column:
        """A stored or derived field. No job is run."""
        return resolve(name, self.df.columns)

    __getitem__ = field

    def vector(self, name: str) -> tuple[Column, ...]:
        return tuple(self.field(c) for c in ALIASES[name])

    def unit_of(self, name: str) -> Unit | None:
        for vector, parts in ALIASES.items():
            if name in parts:
                name = vector
        if name in self.units:
            return Unit.parse(self.units[name])
        if name in _UNITS_OF and all(f in self.units for f, _ in _UNITS_OF[name]):
            out = Unit.parse("1")
            for f, p in _UNITS_OF[name]:
                out = out * Unit.parse(self.units[f]) ** p
            return out
        return None

    def quantity(self, name: str) -> UnitColumn | tuple[UnitColumn, ...]:
        """A field with its unit, for arithmetic that checks dimensions; a vector is a tuple. A field without a unit has no dimension."""
        if name in ALIASES:
            return tuple(self.quantity(c) for c in ALIASES[name])
        return UnitColumn(self.field(name).cast("double"), self.unit_of(name) or Unit.parse("1"))

    def with_quantities(self, **fields: UnitColumn) -> Snapshot:
        """With further fields, whose units the snapshot and the frame's schema keep."""
        return replace(self, df=self.df.withColumns({n: q.named(n) for n, q in fields.items()}), units={**self.units, **{n: text_of(q.unit) for n, q in fields.items()}})

    def aggregate(self, **measures: UnitColumn) -> dict[str, Quantity]:
        """Aggregates of quantities (``mass.sum()``), all in one job."""
        row = self.df.agg(*[q.column.cast("double").alias(n) for n, q in measures.items()]).first()
        return {n: Quantity(float("nan") if row[n] is None else row[n], q.unit) for n, q in measures.items()}

    def keys(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("pid", "family")]

    def all_keys(self) -> list[str]:
        return sorted({*self.keys(), *DERIVED, *(v for v, parts in ALIASES.items() if set(parts) <= set(self.df.columns))})

    def families(self) -> list[str]:
        return sorted(r[0] for r in self.df.select("family").distinct().collect())

    def info(self, name: str) -> tuple[str, Unit | None]:
        """Type and unit of a field, from the schema alone."""
        return self.df.select(self.field(name).alias(name)).schema[name].dataType.simpleString(), self.unit_of(name)

    def with_frame(self, df: DataFrame) -> Snapshot:
        return replace(self, df=df)

    def where(self, predicate: Column) -> Snapshot:
        return self.with_frame(self.df.where(predicate))

    def family(self, name: str) -> Snapshot:
        return self.where(F.col("family") == family_name(name))

    @property
    def s(self) -> Snapshot:
        return self.family("star")

    @property
    def g(self) -> Snapshot:
        return self.family("gas")

    @property
    def dm(self) -> Snapshot:
        return self.family("dm")

    def select(self, key) -> Snapshot:
        """A part of it by filter, family name, predicate, or place: a slice, a number or several. Places are ``pid``, or where there is none those of ``numbered``."""
        from .operators.filters import Filter

        if not isinstance(key, (Filter, Column, str)) and "pid" not in self.df.columns:
            return self.numbered().select(key)

        if isinstance(key, Filter):
            return self.where(key.mask(self))
        if isinstance(key, Column):
            return self.where(key)
        if isinstance(key, str):
            return self.family(key)
        if isinstance(key, int):
            return self.where(F.col("pid") == key)
        if isinstance(key, slice):
            p = F.lit(True)
            if key.start is not None:
                p = p & (F.col("pid") >= key.start)
            if key.stop is not None:
                p = p & (F.col("pid") < key.stop)
            if key.step not in (None, 1):
                p = p & (F.pmod(F.col("pid") - (key.start or 0), F.lit(key.step)) == 0)
            return self.where(p)
        return self.where(F.col("pid").isin(list(key)))

    def numbered(self) -> Snapshot:
        """With ``pid``: each row's place in ``order``. Rows are dealt to tasks by ranges of all columns of the order, counted there, and numbered from what lies before; the dealt rows are persisted, as both steps have to see the same ranges."""
        from .operators.scans import dealt, place

        order = [c for c in self.order if c in self.df.columns and c != "pid"]
        rows = dealt(self.df.drop("pid"), *order)
        held = {r["part"]: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("part")).count().collect()}
        return replace(self, df=rows.withColumn("pid", place(held)), order=("pid",))

    def reduce(self, name: str, how: str) -> Quantity:
        """One number of a field, with its unit: min, max, sum, mean, std, var, median, count, ptp; with ``nan`` before the name NaN counts as missing, else it makes the result NaN."""
        x, skip = self.field(name).cast("double"), how.startswith("nan")
        kind = how.removeprefix("nan")
        if kind not in REDUCTIONS:
            raise ValueError(f"no reduction {how!r}: {sorted(REDUCTIONS)}")
        power, fn = REDUCTIONS[kind]
        value, bad = self.df.agg(fn(F.when(~F.isnan(x), x)), F.max(F.isnan(x))).first()
        if kind == "median" and value:  # the number of values so far
            from .operators.quantiles import Rank, ranked

            value = ranked(self.df, F.lit(0), [x], [Rank(0, 0.5)]).first()["at"]
        elif kind == "median":
            value = None
        unit = self.unit_of(name)
        return Quantity(float("nan") if value is None or (bad and not skip and kind != "count") else float(value), unit if unit is None or power == 1 else unit**power if power else None)

    def topk(self, name: str, k: int) -> list[Quantity]:
        """The ``k`` largest values, from the largest; negative ``k``: the least, from the least."""
        x = self.field(name).cast("double").alias("x")
        rows = self.df.select(x).where("x is not null and not isnan(x)").orderBy(F.desc("x") if k > 0 else F.asc("x")).limit(abs(k)).collect()
        return [Quantity(r["x"], self.unit_of(name)) for r in rows]

    def cumsum(self, name: str, by: str) -> DataFrame:
        """``key, total``: the sum of a field up to each value of another."""
        from .operators.prefix import keyed
        from .operators.scans import running_sum

        rows = keyed(self.df, self.field(by), self.field(name)).groupBy("k").agg(F.sum("w").alias("w"))
        return running_sum(rows, "k", "w", "c").select(F.col("k").alias("key"), F.col("c").alias("total"))

    def physical_units(self, distance: str = "kpc", velocity: str = "km s^-1", mass: str = "Msol") -> Snapshot:
        """Fields of length, velocity and mass in these units: literal factors in one projection."""
        wanted, columns, units = {"pos": distance, "vel": velocity, "mass": mass, "eps": distance}, {}, dict(self.units)
        for name, target in wanted.items():
            if name in units:
                factor = Unit.parse(units[name]).ratio(target)
                units[name] = target
                for c in ALIASES.get(name, (name,)):
                    if c in self.df.columns and factor != 1:
                        columns[c] = F.col(c) * F.lit(factor)
        return replace(self, df=self.df.withColumns(columns) if columns else self.df, units=units)
