"""Columns with units: arithmetic carries dimensions along, and what does not fit fails before a plan is made.

Values stay plain doubles; conversions are literal factors, so Catalyst sees ordinary
expressions. A frame's columns keep their unit in the schema (``metadata["unit"]``), so it
survives writing, reading and further selection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..units import Unit, is_number
from .arithmetic import clip, divide

NONE = Unit.parse("1")


def text_of(unit: Unit) -> str:
    """A text that parses to the same unit: as given if it does, else in base units."""
    try:
        if unit.text and Unit.parse(unit.text) == unit:
            return unit.text
    except ValueError:
        pass
    powers = [f"{name}^{p}" for name, p in zip(("m", "kg", "s", "K"), unit.dims, strict=True) if p]
    return " ".join([repr(unit.factor), *powers]) if unit.factor != 1 or not powers else " ".join(powers)


@dataclass(frozen=True, eq=False)
class UnitColumn:
    """A column and its unit. ``+``, ``-`` and comparisons convert the other side to this one's unit, in which a bare number is taken to be; ``*``, ``/`` and ``**`` make new units, and a number has none there. Texts such as ``"30 kpc"`` are constants with a unit."""

    column: Column
    unit: Unit

    @classmethod
    def of(cls, value: Any, unit: str | Unit = NONE) -> UnitColumn:
        if isinstance(value, UnitColumn):
            return value
        if isinstance(value, (str, Unit)):
            return cls(F.lit(1.0), Unit.parse(value))
        if is_number(value):
            return cls(F.lit(float(value)), Unit.parse(unit))
        if isinstance(value, Column):
            return cls(value, Unit.parse(unit))
        raise TypeError(f"{value!r} is no quantity, column, number or text with a unit")

    @classmethod
    def from_frame(cls, df: DataFrame, name: str) -> UnitColumn:
        """A column with the unit that its schema names; without one it has no dimension."""
        return cls(F.col(f"`{name}`"), Unit.parse((df.schema[name].metadata or {}).get("unit", "1")))

    def to(self, unit: str | Unit) -> UnitColumn:
        target = Unit.parse(unit)
        factor = self.unit.ratio(target)
        return UnitColumn(self.column if factor == 1 else self.column * F.lit(factor), target)

    in_units = to

    def named(self, name: str) -> Column:
        """For a ``select``: the values, with the unit in the schema."""
        return self.column.alias(name, metadata={"unit": text_of(self.unit)})

    def _same(self, other: Any) -> Column:
        """The other side in this one's unit."""
        return UnitColumn.of(other, self.unit).to(self.unit).column

    def _alike(self, other: Any, fn: Callable[[Column, Column], Column]) -> Column:
        return fn(self.column, self._same(other))

    def __add__(self, other: Any) -> UnitColumn:
        return UnitColumn(self._alike(other, lambda a, b: a + b), self.unit)

    def __sub__(self, other: Any) -> UnitColumn:
        return UnitColumn(self._alike(other, lambda a, b: a - b), self.unit)

    def __radd__(self, other: Any) -> UnitColumn:
        return UnitColumn.of(other, self.unit) + self

    def __rsub__(self, other: Any) -> UnitColumn:
        return UnitColumn.of(other, self.unit) - self

    def __mul__(self, other: Any) -> UnitColumn:
        if is_number(other):
            return UnitColumn(self.column * F.lit(float(other)), self.unit)
        o = UnitColumn.of(other)
        return UnitColumn(self.column * o.column, self.unit * o.unit)

    __rmul__ = __mul__

    def __truediv__(self, other: Any) -> UnitColumn:
        if is_number(other):
            return UnitColumn(divide(self.column, F.lit(float(other))), self.unit)
        o = UnitColumn.of(other)
        return UnitColumn(divide(self.column, o.column), self.unit / o.unit)

    def __rtruediv__(self, other: Any) -> UnitColumn:
        return UnitColumn.of(other) / self

    def __pow__(self, power: int | float | Fraction) -> UnitColumn:
        if not isinstance(power, Fraction) and not is_number(power):
            raise TypeError("a power is a number")
        return UnitColumn(F.pow(self.column, F.lit(float(power))), self.unit**power)

    def __neg__(self) -> UnitColumn:
        return UnitColumn(-self.column, self.unit)

    def __abs__(self) -> UnitColumn:
        return UnitColumn(F.abs(self.column), self.unit)

    def __lt__(self, other: Any) -> Column:
        return self._alike(other, lambda a, b: a < b)

    def __le__(self, other: Any) -> Column:
        return self._alike(other, lambda a, b: a <= b)

    def __gt__(self, other: Any) -> Column:
        return self._alike(other, lambda a, b: a > b)

    def __ge__(self, other: Any) -> Column:
        return self._alike(other, lambda a, b: a >= b)

    def equals(self, other: Any) -> Column:
        return self._alike(other, lambda a, b: a == b)

    def __bool__(self) -> bool:
        raise TypeError("a quantity has no truth value before it is run")

    def sqrt(self) -> UnitColumn:
        return UnitColumn(F.sqrt(self.column), self.unit ** Fraction(1, 2))

    def round(self, digits: int = 0) -> UnitColumn:
        return UnitColumn(F.round(self.column, digits), self.unit)

    def clip(self, low: Any = None, high: Any = None) -> UnitColumn:
        bounds = [None if b is None else self._same(b) for b in (low, high)]
        return UnitColumn(clip(self.column, *bounds), self.unit)

    def astype(self, kind: str) -> UnitColumn:
        return UnitColumn(self.column.cast(kind), self.unit)

    def number(self) -> Column:
        """The values of something without dimension."""
        return self.to(NONE).column

    def apply(self, fn: Callable[[Column], Column]) -> UnitColumn:
        """A function of numbers without dimension (``exp``, ``log``, ``sin``)."""
        return UnitColumn(fn(self.number()), NONE)

    # Aggregates: for ``agg``, with the unit that the result has.
    def sum(self) -> UnitColumn:
        return UnitColumn(F.sum(self.column), self.unit)

    def mean(self, weight: UnitColumn | None = None) -> UnitColumn:
        return UnitColumn(F.avg(self.column) if weight is None else divide(F.sum(self.column * weight.column), F.sum(weight.column)), self.unit)

    def min(self) -> UnitColumn:
        return UnitColumn(F.min(self.column), self.unit)

    def max(self) -> UnitColumn:
        return UnitColumn(F.max(self.column), self.unit)

    def std(self) -> UnitColumn:
        return UnitColumn(F.stddev_pop(self.column), self.unit)

    def var(self) -> UnitColumn:
        return UnitColumn(F.var_pop(self.column), self.unit**2)


def dot(a: tuple[UnitColumn, ...], b: tuple[UnitColumn, ...]) -> UnitColumn:
    out, *rest = (x * y for x, y in zip(a, b, strict=True))
    for term in rest:
        out = out + term
    return out


def cross(a: tuple[UnitColumn, ...], b: tuple[UnitColumn, ...]) -> tuple[UnitColumn, ...]:
    return tuple(a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1)))
