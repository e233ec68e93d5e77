"""Properties of a set of particles: sums, centres, densities, order statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, or_
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import divide
from ..plans.core import Calculator, value_of
from ..snapshot import Snapshot
from ..units import gravity_constant, in_units
from .expr import AggregateProperty, Property
from .filters import Annulus, BandPass, above
from .prefix import Bucket, crossing, cut, keyed, narrowed, ordered, reaching, whole
from .scans import first_crossing


@dataclass(eq=False)
class ParamSum(AggregateProperty):
    parameter: str = "mass"

    def columns(self, snap: Snapshot) -> list[Column]:
        return [F.sum(snap.field(self.parameter))]


@dataclass(eq=False)
class Count(AggregateProperty):
    def columns(self, snap: Snapshot) -> list[Column]:
        return [F.count(F.lit(1))]


@dataclass(eq=False)
class VolumeDensity(AggregateProperty):
    """The sum between two radii over the volume between them."""

    rmax: Any
    parameter: str = "mass"
    rmin: Any = 0

    def columns(self, snap: Snapshot) -> list[Column]:
        a, b = (value_of(v, snap, snap.unit_of("pos")) for v in (self.rmin, self.rmax))
        inside = F.coalesce(F.sum(F.when(Annulus(a, b).mask(snap), snap.field(self.parameter))), F.lit(0.0))
        return [divide(inside, 4 / 3 * math.pi * (b * b * b - a * a * a))]


@dataclass(eq=False)
class SurfaceDensity(AggregateProperty):
    rmax: Any
    parameter: str = "mass"
    rmin: Any = 0

    def columns(self, snap: Snapshot) -> list[Column]:
        a, b = (value_of(v, snap, snap.unit_of("pos")) for v in (self.rmin, self.rmax))
        inside = F.coalesce(F.sum(F.when(BandPass("rxy", a, b).mask(snap), snap.field(self.parameter))), F.lit(0.0))
        return [divide(inside, math.pi * (b * b - a * a))]


def weighted(snap: Snapshot, names: Sequence[str], weight: str = "mass") -> list[Column]:
    w = snap.field(weight)
    return [divide(F.sum(w * snap.field(n)), F.sum(w)) for n in names]


@dataclass(eq=False)
class CenterOfMass(AggregateProperty):
    field: str = "pos"

    def __post_init__(self) -> None:
        self.outputs = ("x", "y", "z") if self.field == "pos" else ("vx", "vy", "vz")

    def columns(self, snap: Snapshot) -> list[Column]:
        return weighted(snap, self.outputs)


@dataclass(eq=False)
class PotentialCenter(AggregateProperty):
    """The position of the particle of least potential; of equals the first by ``pid``."""

    outputs = ("x", "y", "z")

    def columns(self, snap: Snapshot) -> list[Column]:
        ties = [F.col(c) for c in snap.order if c in snap.df.columns]
        key = F.struct(snap.field("phi"), *ties)
        at = F.min_by(F.struct(*[c.alias(n) for c, n in zip(snap.vector("pos"), "xyz", strict=True)]), key)
        return [at[c] for c in "xyz"]


#: A shrinking sphere with at most this many particles near it is followed on the driver (32 bytes each).
FEW = 100_000
#: Above ``FEW`` and up to this many particles in the sphere, several steps are decided in one pass.
MANY = 200_000_000
CELLS = 48
AHEAD = 8


class _Ahead(NamedTuple):
    """A step that is foreseen: a guess of the centre, the radius, and how far the guess may be off."""

    at: np.ndarray
    r: float
    off: float


@dataclass(eq=False)
class ShrinkingSphere(Property):
    """The centre of mass of a sphere that shrinks by ``factor`` round it until fewer than ``least`` particles are in it.

    Steps depend on each other, but not on all rows. Mergeable sums on a grid round the sphere
    foretell the next centres, each with a margin. One pass then sums, for each step ahead, what
    is inside by more than its margin, and gathers the rows within a margin of a sphere's surface.
    From these the steps are done exactly, as long as each centre is as near to its guess as its
    margin says. Where the rows at the surfaces would be too many, a step is an ``agg`` of its own;
    once few particles are near the sphere, all further steps take those.
    """

    radius: Any = None
    factor: float = 0.7
    least: int = 100
    start: Any = None
    max_steps: int = 200
    outputs = ("x", "y", "z")

    def centre(self, snap: Snapshot) -> tuple[float, float, float]:
        frame = snap.df.select(*[c.cast("double").alias(n) for c, n in zip(snap.vector("pos"), "xyz", strict=True)], F.coalesce(snap.field("mass").cast("double"), F.lit(0.0)).alias("mass")).persist()
        try:
            n, *middle = frame.agg(F.count(F.lit(1)), *weighted(Snapshot(frame), "xyz")).first()
            at = tuple(self.start(snap)) if callable(self.start) else self.start or tuple(middle)
            if self.radius is not None:
                r = in_units(self.radius, snap.unit_of("pos"))
            else:
                r = math.sqrt(frame.agg(F.max(_square(at))).first()[0] or 0.0) * self.factor
            left = self.max_steps
            while left > 0:
                if n <= FEW:
                    done = self._near(frame, at, r, left)
                elif n <= MANY:
                    done = self._several(frame, at, r, left)
                else:
                    done = None
                at, r, n, taken, ended = done or self._one(frame, at, r)
                if ended:
                    break
                left -= taken
            return tuple(map(float, at))
        finally:
            frame.unpersist()

    def _after(self, at: Any, r: float, n: int, sums: Any) -> tuple[Any, float, bool]:
        """The centre and radius after a step with these sums of mass and of mass by place, and whether it was the last."""
        if n:
            at = tuple(float(v / sums[0]) if sums[0] else math.nan for v in sums[1:])
        return at, r * self.factor, n < self.least

    def _one(self, frame: DataFrame, at: Any, r: float) -> tuple[Any, float, int, int, bool]:
        n, *sums = frame.where(_square(at) < r * r).agg(F.count(F.lit(1)), *_sums()).first()
        at, r, ended = self._after(at, r, n, sums)
        return at, r, n, 1, ended

    def _near(self, frame: DataFrame, at: Any, r: float, left: int) -> tuple[Any, float, int, int, bool] | None:
        """The steps whose spheres lie in twice the radius, from the rows there; None if these are many."""
        reach, first = 2 * r, np.array(at, float)
        rows = frame.where(_square(at) <= reach * reach).limit(2 * FEW + 1).toArrow()
        if rows.num_rows > 2 * FEW:
            return None
        pos, mass = np.stack([rows[c].to_numpy() for c in "xyz"], 1), rows["mass"].to_numpy()
        taken, n, ended = 0, 0, False
        while taken < left and not ended and np.linalg.norm(np.array(at, float) - first) + r <= reach * (1 - 1e-12):
            inside = _squares(pos, at) < r * r
            n = int(inside.sum())
            at, r, ended = self._after(at, r, n, [mass[inside].sum(), *(mass[inside] @ pos[inside])])
            taken += 1
        return (at, r, n, taken, ended) if taken else None

    def _ahead(self, frame: DataFrame, at: Any, r: float, left: int) -> list[_Ahead]:
        """The steps to come, foretold from sums by cell: as many as have few enough rows at their surfaces."""
        if r <= 0:
            return []
        width = 2 * r / CELLS
        axis = [F.least(F.floor((F.col(c) - (v - r)) / width), F.lit(CELLS - 1)).cast("int") for c, v in zip("xyz", at, strict=True)]
        cells = frame.where(_square(at) < r * r).groupBy(((axis[0] * CELLS + axis[1]) * CELLS + axis[2]).alias("cell")).agg(F.count(F.lit(1)).alias("n"), *_sums()).toArrow()
        held, mass = cells["n"].to_numpy(), cells["mass"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            middle = np.stack([cells[c].to_numpy() for c in "xyz"], 1) / mass[:, None]
        steps, rows = [], 0.0
        guess, off = np.array(at, float), 1e-12 * r
        for _ in range(min(left, AHEAD)):
            far = np.sqrt(_squares(middle, guess))
            inside, edge = far < r, np.abs(far - r) <= width
            rows += float(held[edge].sum()) * min(1.0, off / width)
            if rows > FEW or not inside.any() or off > 0.25 * r:
                break
            steps.append(_Ahead(guess, r, off))
            whole = mass[inside].sum()
            # Cells at the surface are taken whole or not at all; what that adds is of either sign.
            off = 1.1 * off + 3 * float(np.sqrt(((mass[edge] * far[edge]) ** 2).sum())) / whole if whole > 0 else math.inf
            guess, r = mass[inside] @ middle[inside] / whole, r * self.factor
        return steps

    def _several(self, frame: DataFrame, at: Any, r: float, left: int) -> tuple[Any, float, int, int, bool] | None:
        """Several steps from one pass; None if fewer than two can be foretold."""
        steps = self._ahead(frame, at, r, left)
        if len(steps) < 2:
            return None
        far = [F.sqrt(_square(tuple(map(float, s.at)))) for s in steps]
        sure = [d < s.r - s.off for d, s in zip(far, steps, strict=True)]
        sums = frame.agg(*[F.coalesce(F.sum(F.when(inside, v)), F.lit(0)).alias(f"{name}{k}") for k, inside in enumerate(sure) for name, v in (("n", F.lit(1)), *_parts())]).first()
        close = reduce(or_, [F.abs(d - s.r) <= s.off for d, s in zip(far, steps, strict=True)])
        rows = frame.where(close).select("x", "y", "z", "mass", *[c.alias(f"sure{k}") for k, c in enumerate(sure)]).limit(4 * FEW + 1).toArrow()
        if rows.num_rows > 4 * FEW:
            return None
        pos, mass = np.stack([rows[c].to_numpy() for c in "xyz"], 1), rows["mass"].to_numpy()
        taken, n, ended = 0, 0, False
        for k, step in enumerate(steps):
            if ended or np.linalg.norm(np.array(at, float) - step.at) > step.off * (1 - 1e-9):
                break
            more = (_squares(pos, at) < r * r) & ~rows[f"sure{k}"].to_numpy(zero_copy_only=False).astype(bool)
            n = int(sums[f"n{k}"] + more.sum())
            whole = [sums[f"{c}{k}"] + v for c, v in zip(("mass", "x", "y", "z"), (mass[more].sum(), *(mass[more] @ pos[more])), strict=True)]
            at, r, ended = self._after(at, r, n, whole)
            taken += 1
        return at, r, n, taken, ended

    def frame(self, snap: Snapshot) -> DataFrame:
        at = self.centre(snap)
        return snap.df.sparkSession.range(1).select(*[F.lit(v).alias(n) for v, n in zip(at, "xyz", strict=True)])

    def scalars(self, snap: Snapshot) -> list[Column]:
        return [F.lit(v) for v in self.centre(snap)]


def _square(at: Any) -> Column:
    return reduce(add, [(F.col(c) - v) * (F.col(c) - v) for c, v in zip("xyz", map(float, at), strict=True)])


def _squares(pos: np.ndarray, at: Any) -> np.ndarray:
    d = pos - np.array(at, float)
    return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]


def _parts() -> list[tuple[str, Column]]:
    return [("mass", F.col("mass")), *[(c, F.col("mass") * F.col(c)) for c in "xyz"]]


def _sums() -> list[Column]:
    return [F.sum(v).alias(name) for name, v in _parts()]


def CenPos(mode: str = "ssc") -> Calculator:
    """The centre: "com" (of mass), "pot" (least potential), "ssc" (shrinking sphere) or "hyb" (a sphere of 5 kpc that shrinks from the least potential)."""
    if mode == "com":
        return CenterOfMass()
    if mode == "pot":
        return PotentialCenter()
    if mode == "ssc":
        return ShrinkingSphere()
    if mode == "hyb":
        return _Hybrid()
    raise ValueError(f"mode {mode!r} is none of com, pot, ssc, hyb")


@dataclass(eq=False)
class _Hybrid(Property):
    outputs = ("x", "y", "z")

    def _inner(self, snap: Snapshot) -> ShrinkingSphere:
        return ShrinkingSphere(radius="5 kpc" if snap.unit_of("pos") else 5.0, start=PotentialCenter())

    def frame(self, snap: Snapshot) -> DataFrame:
        return self._inner(snap).frame(snap)

    def scalars(self, snap: Snapshot) -> list[Column]:
        return self._inner(snap).scalars(snap)


def CenVel(mode: str = "com") -> Calculator:
    if mode != "com":
        raise ValueError(f"mode {mode!r} is not com")
    return CenterOfMass("vel")


@dataclass(eq=False)
class AngMomVec(AggregateProperty):
    outputs = ("jx", "jy", "jz")

    def columns(self, snap: Snapshot) -> list[Column]:
        (x, y, z), (u, v, w), m = snap.vector("pos"), snap.vector("vel"), snap.field("mass")
        return [F.sum(m * (y * w - z * v)), F.sum(m * (z * u - x * w)), F.sum(m * (x * v - y * u))]


@dataclass(eq=False)
class KappaRot(AggregateProperty):
    """The share of the kinetic energy that is in rotation."""

    def columns(self, snap: Snapshot) -> list[Column]:
        v, m = snap.field("vcxy"), snap.field("mass")
        return [divide(F.sum(0.5 * m * v * v), F.sum(m * snap.field("ke")))]


@dataclass(eq=False)
class KappaRotMean(AggregateProperty):
    """The mean of that share over particles; those at rest have none."""

    def columns(self, snap: Snapshot) -> list[Column]:
        v, ke = snap.field("vcxy"), snap.field("ke")
        return [F.avg(F.when(ke > 0, 0.5 * v * v / ke))]


@dataclass(eq=False)
class PatternSpeed(AggregateProperty):
    """Of a bar, from the moments of inertia and their rates."""

    def columns(self, snap: Snapshot) -> list[Column]:
        x, y, _ = snap.vector("pos")
        u, v, _ = snap.vector("vel")
        m = snap.field("mass")
        half, cross = 0.5 * (F.sum(m * x * x) - F.sum(m * y * y)), F.sum(m * x * y)
        d_cross, d_half = F.sum(m * (x * v + y * u)), F.sum(m * (x * u - y * v))
        return [divide(0.5 * (half * d_cross - d_half * cross), half * half + cross * cross)]


@dataclass(eq=False)
class ParamContain(Property):
    """The key within which a share of the parameter lies: keys in order, the sum of the parameter less its first value, over the last; linear between particles. Two passes find the buckets, and only these are put in order."""

    cal_key: str = "r"
    frac: float | Sequence[float] = 0.5
    parameter: str = "mass"

    def __post_init__(self) -> None:
        self.fracs = [float(p) for p in (self.frac if isinstance(self.frac, (list, tuple, np.ndarray)) else [self.frac])]
        if not all(0 < p < 1 for p in self.fracs):
            raise ValueError("a share is between 0 and 1")
        self.outputs = ("value",) if not isinstance(self.frac, (list, tuple, np.ndarray)) else tuple(f"p{i}" for i in range(len(self.fracs)))

    def frame(self, snap: Snapshot) -> DataFrame:
        rows = keyed(snap.df, snap.field(self.cal_key), snap.field(self.parameter))
        buckets, first = cut(rows)
        total = whole(buckets)
        if buckets and not total - first > 0:
            raise ValueError(f"the sum of {self.parameter} is not positive")
        targets = [first + p * (total - first) for p in self.fracs] if buckets else [0.0] * len(self.fracs)
        held = [b for t in targets for b in narrowed(rows, buckets, reaching(t))]
        return ordered(rows, held).agg(*[crossing(t).alias(o) for t, o in zip(targets, self.outputs, strict=True)])

    def public(self, row: Row) -> Any:
        if row[0] is None:
            raise ValueError("no particles")
        return row[0] if self.outputs == ("value",) else np.array(list(row))


@dataclass(eq=False)
class RadiusAtSurfaceDensity(Property):
    """The radius at which the surface density first crosses ``target``: "shell" (in a ring of width ``eps``) or "total" (within the radius). A grid of ``points`` radii finds the interval in one pass; then its radii are dealt to tasks by ranges, and each looks for the first crossing from what the ranges before it hold."""

    target: Any
    parameter: str = "mass"
    mode: str = "shell"
    r_key: str = "rxy"
    eps: float = 0.01
    rmin: float = 0.0
    rmax: float | None = None
    points: int = 256

    def _density(self, r: Column, key: Column, value: Column) -> Column:
        if self.mode == "shell":
            a, b = F.greatest(r - self.eps / 2, F.lit(0.0)), r + self.eps / 2
            return F.coalesce(F.sum(F.when((key >= a) & (key <= b), value)), F.lit(0.0)) / (math.pi * (b * b - a * a))
        if self.mode == "total":
            return F.coalesce(F.sum(F.when(key <= r, value)), F.lit(0.0)) / (math.pi * r * r)
        raise ValueError(f"mode {self.mode!r} is neither shell nor total")

    def bracket(self, snap: Snapshot) -> DataFrame:
        """``g, left, right``: the first interval of the grid in which the density crosses the target."""
        key, value = snap.field(self.r_key), snap.field(self.parameter)
        rows = snap.df.select(key.alias("k"), value.alias("w"))
        low = max(self.rmin, self.eps)
        top = F.lit(self.rmax) if self.rmax is not None else rows.agg(F.max("k")).scalar()
        n = self.points
        step = (top - low) / (n - 1)
        half = self.eps / 2
        # Each particle adds to a stretch of the grid: counted where it begins and where it ends.
        if self.mode == "shell":
            first, last = F.ceil((F.col("k") - half - low) / step), F.floor((F.col("k") + half - low) / step)
        else:
            first, last = F.ceil((F.col("k") - low) / step), F.lit(n - 1)
        marks = rows.select("w", F.greatest(first, F.lit(0)).alias("i"), F.least(last, F.lit(n - 1)).alias("j")).where("i <= j")
        marks = marks.select(F.explode(F.array(F.struct(F.col("i").alias("g"), F.col("w").alias("d")), F.struct((F.col("j") + 1).alias("g"), (-F.col("w")).alias("d")))).alias("m")).select("m.g", "m.d")
        grid = snap.df.sparkSession.range(n).select(F.col("id").alias("g"))
        # ``points`` rows: one task
        every = grid.join(F.broadcast(marks.groupBy("g").agg(F.sum("d").alias("d"))), "g", "left").select("g", F.coalesce(F.sum("d").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("held"))
        r = F.lit(low) + F.col("g") * step
        if self.mode == "shell":
            a, b = F.greatest(r - half, F.lit(0.0)), r + half
            area = math.pi * (b * b - a * a)
        else:
            area = math.pi * r * r
        side = every.select("g", r.alias("left"), (F.greatest(F.col("held") / area, F.lit(0.0)) - value_of(self.target, snap, None)).alias("d"))
        w = Window.orderBy("g")
        crossed = side.select("g", "left", F.lead("left").over(w).alias("right"), ((F.col("d") < 0) != (F.lead("d").over(w) < 0)).alias("crossed")).where("crossed")
        return crossed.orderBy("g").limit(1).select("g", "left", "right")

    def frame(self, snap: Snapshot) -> DataFrame:
        found = self.bracket(snap).first()
        if found is None:
            raise ValueError("the density does not cross the target")
        _, left, right = found
        target = snap.df.sparkSession.range(1).select(value_of(self.target, snap, None).alias("t")).first()[0]
        key, value = snap.field(self.r_key), snap.field(self.parameter)
        near = snap.df.select(key.cast("double").alias("k"), value.cast("double").alias("w"))
        half = self.eps / 2
        # What is held changes at these radii; a ring holds both its ends, so what leaves does so behind its radius.
        if self.mode == "shell":
            steps = near.where((F.col("k") >= left - self.eps) & (F.col("k") <= right + self.eps))
            steps = steps.select(F.explode(F.array(F.struct((F.col("k") - half).alias("r"), F.lit(0).alias("late"), F.col("w").alias("d")), F.struct((F.col("k") + half).alias("r"), F.lit(1).alias("late"), (-F.col("w")).alias("d")))).alias("s")).select("s.*")
            inner = 0.0
        else:
            steps = near.where((F.col("k") > left) & (F.col("k") <= right)).select(F.col("k").alias("r"), F.lit(0).alias("late"), F.col("w").alias("d"))
            inner = near.where(F.col("k") <= left).agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        ends = snap.df.sparkSession.createDataFrame([(left, 0, 0.0), (right, 0, 0.0)], "r double, late int, d double")
        steps = steps.unionByName(ends).groupBy("r", "late").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))
        shell, eps = self.mode == "shell", self.eps

        def density(mass: np.ndarray, r: np.ndarray) -> np.ndarray:
            mass = np.maximum(mass, 0.0)
            if shell:
                a, b = np.maximum(r - half, 0.0), r + half
                return mass / (math.pi * (b * b - a * a))
            return mass / (math.pi * r * r)

        def crossing_of(r: np.ndarray, was: np.ndarray, held: np.ndarray, after: np.ndarray) -> float | None:
            # Between changes the density falls: as 1 / r in a ring, as 1 / r^2 in a circle.
            falls = held / (2 * math.pi * eps * target) if shell else np.sqrt(np.maximum(held, 0.0) / (math.pi * target))
            here, inside = density(held, r), (r >= left) & (r <= right)
            up = inside & (r > left) & ((density(was, r) < target) != (here < target))
            down = inside & (here >= target) & (density(held, after) < target) & (after <= right)
            least = np.minimum(np.where(up, r, np.inf), np.where(down, falls, np.inf)).min(initial=np.inf)
            return float(least) if np.isfinite(least) else None

        at = first_crossing(steps, float(inner), crossing_of)
        return snap.df.sparkSession.range(1).select(F.lit(at).cast("double").alias("value"))


@dataclass(eq=False)
class VirialRadius(Property):
    """The largest radius within which the mean density is at least ``overdensity`` times ``rho_def``."""

    overdensity: float = 178.0
    rho_def: float = 1.0

    def frame(self, snap: Snapshot) -> DataFrame:
        rows = keyed(snap.df, snap.field("r"), snap.field("mass"))
        buckets, _ = cut(rows)
        level = self.overdensity * self.rho_def * 4 / 3 * math.pi

        def least_answer(parts: list[Bucket]) -> float:
            return max((b.most for b in parts if b.base + b.total >= level * b.most**3), default=-math.inf)

        # A bucket may hold the answer if its whole sum is dense enough at its first radius, and none beyond is sure to be.
        sure = least_answer(buckets)
        held = narrowed(rows, buckets, lambda b: b.most >= sure and b.base + b.total >= level * b.least**3)
        dense = F.col("c") >= level * F.pow(F.col("k"), F.lit(3.0))
        return ordered(rows, held).agg(F.max(F.when(dense, F.col("k"))).alias("value"))


@dataclass(eq=False)
class SpinParam(AggregateProperty):
    """Angular momentum over sqrt(2) M V R, with R the largest radius and V the circular velocity there. ``g``: the constant of gravity; by default that of the snapshot's units, else 1."""

    g: float | None = None

    def columns(self, snap: Snapshot) -> list[Column]:
        g = self.g
        if g is None:
            u = [snap.units.get(k) for k in ("pos", "mass", "vel")]
            g = gravity_constant(*u) if all(u) else 1.0
        j = AngMomVec().columns(snap)
        mass, r = F.sum(snap.field("mass")), F.max(snap.field("r"))
        return [divide(F.sqrt(j[0] * j[0] + j[1] * j[1] + j[2] * j[2]), F.sqrt(F.lit(2.0)) * mass * F.sqrt(g * mass / r) * r)]


__all__ = ["AngMomVec", "CenPos", "CenVel", "CenterOfMass", "Count", "KappaRot", "KappaRotMean", "ParamContain", "ParamSum", "PatternSpeed", "PotentialCenter", "RadiusAtSurfaceDensity", "ShrinkingSphere", "SpinParam", "SurfaceDensity", "VirialRadius", "VolumeDensity", "above"]
