"""Filters: predicates on particles that compose by ``& | ~``. All bounds are strict.

A comparison with NaN is false, as in floating-point arithmetic; Spark orders NaN above every
number, so lower bounds test for it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.core import signature_of, value_of, vector_of
from ..snapshot import Snapshot, family_name
from ..units import in_units


def above(c: Column, low: Column) -> Column:
    return (c > low) & ~F.isnan(c)


class Filter:
    def mask(self, snap: Snapshot) -> Column:
        raise NotImplementedError

    def __call__(self, snap: Snapshot) -> Snapshot:
        return snap.where(self.mask(snap))

    def where(self, snap: Snapshot) -> DataFrame:
        """The ``pid`` of the particles for which it holds."""
        return snap.df.where(self.mask(snap)).select("pid")

    def signature(self) -> Any:
        return (type(self).__name__, *((k, signature_of(v)) for k, v in vars(self).items()))

    def __and__(self, other: Filter) -> Filter:
        return And(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Or(self, other)

    def __invert__(self) -> Filter:
        return Not(self)

    def __xor__(self, other: Filter) -> Filter:
        raise TypeError("filters have no ^")


@dataclass(frozen=True)
class And(Filter):
    left: Filter
    right: Filter

    def mask(self, snap: Snapshot) -> Column:
        return self.left.mask(snap) & self.right.mask(snap)


@dataclass(frozen=True)
class Or(Filter):
    left: Filter
    right: Filter

    def mask(self, snap: Snapshot) -> Column:
        return self.left.mask(snap) | self.right.mask(snap)


@dataclass(frozen=True)
class Not(Filter):
    child: Filter

    def mask(self, snap: Snapshot) -> Column:
        return ~self.child.mask(snap)


@dataclass(frozen=True)
class Where(Filter):
    """``function(snapshot) -> Column`` as a filter."""

    function: Any

    def mask(self, snap: Snapshot) -> Column:
        return self.function(snap)


@dataclass(frozen=True)
class FamilyFilter(Filter):
    family: Any

    def __post_init__(self) -> None:
        if not callable(self.family):
            family_name(self.family)

    def mask(self, snap: Snapshot) -> Column:
        return F.col("family") == family_name(self.family(snap) if callable(self.family) else self.family)


class VolumeFilter(Filter):
    def _lengths(self, snap: Snapshot, *values: Any) -> list[float]:
        from ..plans.core import Calculator

        unit = snap.unit_of("pos")
        return [in_units(v(snap) if callable(v) or isinstance(v, Calculator) else v, unit) for v in values]

    def volume(self, snap: Snapshot) -> float:
        raise NotImplementedError

    def _from_centre(self, snap: Snapshot, cen: Any) -> tuple[Column, Column, Column]:
        unit = snap.unit_of("pos")
        if isinstance(cen, tuple) and all(c == 0 for c in cen if not isinstance(c, Column)) and not any(isinstance(c, Column) for c in cen):
            return snap.vector("pos")
        return tuple(p - c for p, c in zip(snap.vector("pos"), vector_of(cen, snap, unit), strict=True))


@dataclass(frozen=True)
class Sphere(VolumeFilter):
    radius: Any
    cen: Any = (0.0, 0.0, 0.0)

    def mask(self, snap: Snapshot) -> Column:
        x, y, z = self._from_centre(snap, self.cen)
        r = value_of(self.radius, snap, snap.unit_of("pos"))
        return x * x + y * y + z * z < r * r

    def volume(self, snap: Snapshot) -> float:
        (r,) = self._lengths(snap, self.radius)
        return 4 / 3 * math.pi * r**3


@dataclass(frozen=True)
class Annulus(VolumeFilter):
    """A spherical shell: in the sphere of ``r2`` and not in that of ``r1``."""

    r1: Any
    r2: Any
    cen: Any = (0.0, 0.0, 0.0)

    def mask(self, snap: Snapshot) -> Column:
        return Sphere(self.r2, self.cen).mask(snap) & ~Sphere(self.r1, self.cen).mask(snap)

    def volume(self, snap: Snapshot) -> float:
        a, b = self._lengths(snap, self.r1, self.r2)
        return 4 / 3 * math.pi * (b**3 - a**3)


@dataclass(frozen=True)
class Disc(VolumeFilter):
    radius: Any
    height: Any
    cen: Any = (0.0, 0.0, 0.0)

    def mask(self, snap: Snapshot) -> Column:
        x, y, z = self._from_centre(snap, self.cen)
        r, h = (value_of(v, snap, snap.unit_of("pos")) for v in (self.radius, self.height))
        return (x * x + y * y < r * r) & (F.abs(z) < h)

    def volume(self, snap: Snapshot) -> float:
        r, h = self._lengths(snap, self.radius, self.height)
        return 2 * math.pi * r * r * h


@dataclass(frozen=True)
class SolarNeighborhood(VolumeFilter):
    """A ring: between two cylinders, within a height."""

    r1: Any = "5 kpc"
    r2: Any = "10 kpc"
    height: Any = "2 kpc"
    cen: Any = (0.0, 0.0, 0.0)

    def mask(self, snap: Snapshot) -> Column:
        return Disc(self.r2, self.height, self.cen).mask(snap) & ~Disc(self.r1, self.height, self.cen).mask(snap)

    def volume(self, snap: Snapshot) -> float:
        a, b, h = self._lengths(snap, self.r1, self.r2, self.height)
        return 2 * math.pi * h * (b * b - a * a)


@dataclass(frozen=True)
class Cuboid(VolumeFilter):
    """Bounds that are not given follow from the first: y1 = z1 = x1, and the upper ones mirror the lower."""

    x1: Any
    y1: Any = None
    z1: Any = None
    x2: Any = None
    y2: Any = None
    z2: Any = None

    def _low_high(self, snap: Snapshot) -> tuple[list[Column], list[Column]]:
        unit = snap.unit_of("pos")
        low = [value_of(self.x1 if v is None else v, snap, unit) for v in (self.x1, self.y1, self.z1)]
        return low, [-a if v is None else value_of(v, snap, unit) for a, v in zip(low, (self.x2, self.y2, self.z2), strict=True)]

    def mask(self, snap: Snapshot) -> Column:
        out = F.lit(True)
        for p, a, b in zip(snap.vector("pos"), *self._low_high(snap), strict=True):
            out = out & above(p, a) & (p < b)
        return out

    def volume(self, snap: Snapshot) -> float:
        low = self._lengths(snap, *[self.x1 if v is None else v for v in (self.x1, self.y1, self.z1)])
        high = [-a if v is None else self._lengths(snap, v)[0] for a, v in zip(low, (self.x2, self.y2, self.z2), strict=True)]
        return math.prod(abs(b - a) for a, b in zip(low, high, strict=True))


@dataclass(frozen=True)
class BandPass(Filter):
    prop: str
    min: Any
    max: Any

    def mask(self, snap: Snapshot) -> Column:
        c, unit = snap.field(self.prop), snap.unit_of(self.prop)
        return above(c, value_of(self.min, snap, unit)) & (c < value_of(self.max, snap, unit))


@dataclass(frozen=True)
class HighPass(Filter):
    prop: str
    min: Any

    def mask(self, snap: Snapshot) -> Column:
        return above(snap.field(self.prop), value_of(self.min, snap, snap.unit_of(self.prop)))


@dataclass(frozen=True)
class LowPass(Filter):
    prop: str
    max: Any

    def mask(self, snap: Snapshot) -> Column:
        return snap.field(self.prop) < value_of(self.max, snap, snap.unit_of(self.prop))
