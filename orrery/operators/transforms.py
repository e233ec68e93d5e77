"""Frame transforms: projections that rewrite positions and velocities of the whole snapshot.

A transform's own parameters are measured on the frame before it, on a filtered part if
``measure_with`` was given, and then all particles move. The parent frame is untouched, so
undoing a transform is using the parent.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.core import Calculator, signature_of, vector_of
from ..snapshot import Snapshot
from ..units import in_units
from .properties import AngMomVec, CenPos, CenVel


class Transform:
    measure: Any = None

    def apply(self, snap: Snapshot) -> Snapshot:
        raise NotImplementedError

    def __call__(self, snap: Snapshot) -> Snapshot:
        return self.apply(snap)

    def measure_with(self, filter_: Any) -> Transform:
        """The same transform with its parameters measured on a part of the snapshot."""
        return replace(self, measure=filter_ if self.measure is None else self.measure & filter_)

    def measured(self, snap: Snapshot) -> Snapshot:
        return snap if self.measure is None else snap.where(self.measure.mask(snap))

    def then(self, *others: Transform) -> Chain:
        return Chain((*_steps(self), *(s for o in others for s in _steps(o))))

    def signature(self) -> Any:
        return (type(self).__name__, *((k, signature_of(v)) for k, v in vars(self).items()))


def _steps(t: Transform) -> tuple[Transform, ...]:
    return t.steps if isinstance(t, Chain) else (t,)


@dataclass(frozen=True)
class Chain(Transform):
    """Each step sees what the one before it made."""

    steps: tuple[Transform, ...]
    measure: Any = None

    def apply(self, snap: Snapshot) -> Snapshot:
        for s in self.steps:
            snap = s.apply(snap)
        return snap

    def measure_with(self, filter_: Any) -> Chain:
        return Chain(tuple(s.measure_with(filter_) for s in self.steps))


def chain(*transforms: Transform) -> Chain:
    return Chain(tuple(s for t in transforms for s in _steps(t)))


def _shifted(snap: Snapshot, names: tuple[str, ...], by: list[Column]) -> Snapshot:
    return snap.with_frame(snap.df.withColumns({n: F.col(n) - c for n, c in zip(names, by, strict=True)}))


def _vector(mode: Any, of_mode: Any, snap: Snapshot, unit: Any) -> list[Column]:
    """A named mode, a calculator, a callable or three numbers. A measured vector moves several columns, so it is run once and its numbers put in."""
    if isinstance(mode, str):
        mode = of_mode(mode)
    if isinstance(mode, Calculator):
        row = mode.frame(snap).first()
        if any(v is None for v in row):
            raise ValueError(f"{mode.label()} has no value here")
        return [F.lit(float(v)) for v in row]
    return vector_of(mode, snap, unit)


@dataclass(frozen=True)
class ShiftPosTo(Transform):
    mode: Any = "ssc"
    measure: Any = None

    def apply(self, snap: Snapshot) -> Snapshot:
        return _shifted(snap, ("x", "y", "z"), _vector(self.mode, CenPos, self.measured(snap), snap.unit_of("pos")))


@dataclass(frozen=True)
class ShiftVelTo(Transform):
    mode: Any = "com"
    measure: Any = None

    def apply(self, snap: Snapshot) -> Snapshot:
        return _shifted(snap, ("vx", "vy", "vz"), _vector(self.mode, CenVel, self.measured(snap), snap.unit_of("vel")))


def face_on(vector: Any, up: Any = None) -> np.ndarray:
    """The rotation that takes ``vector`` to +z; ``up`` fixes the turn about it, another axis if it is nearly parallel."""
    v = np.asarray(vector, float)
    size = np.linalg.norm(v)
    if not np.isfinite(size) or size == 0:
        raise ValueError("the vector is zero or not finite")
    z = v / size
    u = np.asarray([0.0, 1.0, 0.0] if up is None else up, float)
    if abs(u @ z) > (1 - 1e-6) * np.linalg.norm(u):
        u = np.eye(3)[np.argmin(np.abs(z))]
    x = np.cross(u, z)
    x /= np.linalg.norm(x)
    return np.array([x, np.cross(z, x), z])


@dataclass(frozen=True)
class Rotate(Transform):
    matrix: Any
    measure: Any = None

    def apply(self, snap: Snapshot) -> Snapshot:
        m, columns = np.asarray(self.matrix, float), {}
        for names in (("x", "y", "z"), ("vx", "vy", "vz"), ("ax", "ay", "az")):
            if set(names) <= set(snap.df.columns):
                for row, n in zip(m, names, strict=True):
                    columns[n] = sum((F.lit(float(a)) * F.col(c) for a, c in zip(row, names, strict=True)), F.lit(0.0))
        return snap.with_frame(snap.df.withColumns(columns))


@dataclass(frozen=True)
class AlignVec(Transform):
    """Turn positions and velocities so that the vector (a calculator, callable or numbers) points along +z."""

    vector: Any
    up: Any = None
    measure: Any = None

    def apply(self, snap: Snapshot) -> Snapshot:
        v = self.vector
        if isinstance(v, Calculator):
            v = list(v.frame(self.measured(snap)).first())
        elif callable(v):
            v = v(self.measured(snap))
        if any(x is None for x in v):
            raise ValueError("the vector has no value here")
        return Rotate(face_on(v, self.up)).apply(snap)


def AlignAngMomVec(up: Any = None) -> AlignVec:
    return AlignVec(AngMomVec(), up)


@dataclass(frozen=True)
class WrapBox(Transform):
    """Periodic wrap: "center" to [-L/2, L/2), "upper" to [0, L), "minirange" by axis to whichever spans less, "center" if equal. An explicit size comes before the snapshot's own."""

    boxsize: Any = None
    convention: str = "minirange"
    measure: Any = None

    def apply(self, snap: Snapshot) -> Snapshot:
        if self.convention not in ("center", "upper", "minirange"):
            raise ValueError(f"convention {self.convention!r} is none of center, upper, minirange")
        size = self.boxsize if self.boxsize is not None else snap.properties.get("boxsize")
        size = None if size is None else in_units(size, snap.unit_of("pos"))
        if size is None or not size > 0 or not math.isfinite(size):
            warnings.warn("no box size: not wrapped", stacklevel=2)
            return snap

        def wrapped(c: str, low: float) -> Column:
            return F.col(c) - F.floor((F.col(c) - F.lit(low)) / F.lit(size)) * F.lit(size)

        both = {n: (wrapped(n, -size / 2), wrapped(n, 0.0)) for n in "xyz"}
        if self.convention != "minirange":
            k = 0 if self.convention == "center" else 1
            return snap.with_frame(snap.df.withColumns({n: b[k] for n, b in both.items()}))
        part = self.measured(snap).df
        spans = part.agg(*[(F.max(c) - F.min(c)).alias(f"{n}{k}") for n, b in both.items() for k, c in enumerate(b)]).first()
        return snap.with_frame(snap.df.withColumns({n: b[0 if spans[f"{n}0"] is None or spans[f"{n}0"] <= spans[f"{n}1"] else 1] for n, b in both.items()}))
