"""Scalar algebra of calculators: ``a + b``, ``abs(a)``, ``a.clip(0, 1)`` and comparisons are calculators again.

Over one scope an expression of aggregates is still one ``agg``.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clip, divide
from ..plans.core import Aggregate, Calculator, signature_of
from ..snapshot import Snapshot
from ..units import is_number

_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": operator.add, "mul": operator.mul, "sub": operator.sub, "div": divide, "pow": lambda a, b: F.pow(a, b),
    "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge, "eq": operator.eq, "ne": operator.ne,
}
_UNARY: dict[str, Callable[[Column], Column]] = {"neg": operator.neg, "pos": lambda c: c, "abs": F.abs}


class Property(Calculator):
    """A calculator with arithmetic."""

    def _op(self, op: str, *others: Any, swap: bool = False) -> Op:
        own = [self, *map(as_property, others)]
        return Op.of(op, own[::-1] if swap else own)

    def __add__(self, o):
        return self._op("add", o)

    def __radd__(self, o):
        return self._op("add", o, swap=True)

    def __mul__(self, o):
        return self._op("mul", o)

    def __rmul__(self, o):
        return self._op("mul", o, swap=True)

    def __sub__(self, o):
        return self._op("sub", o)

    def __rsub__(self, o):
        return self._op("sub", o, swap=True)

    def __truediv__(self, o):
        return self._op("div", o)

    def __rtruediv__(self, o):
        return self._op("div", o, swap=True)

    def __pow__(self, o):
        return self._op("pow", o)

    def __rpow__(self, o):
        return self._op("pow", o, swap=True)

    def __neg__(self):
        return self._op("neg")

    def __pos__(self):
        return self._op("pos")

    def __abs__(self):
        return self._op("abs")

    def lt(self, o):
        return self._op("lt", o)

    def le(self, o):
        return self._op("le", o)

    def gt(self, o):
        return self._op("gt", o)

    def ge(self, o):
        return self._op("ge", o)

    def eq_(self, o):
        return self._op("eq", o)

    def ne(self, o):
        return self._op("ne", o)

    def clip(self, vmin: Any = None, vmax: Any = None) -> Clip:
        return Clip(self, vmin, vmax)

    def __bool__(self) -> bool:
        raise TypeError("a calculator has no truth value before it is run")


class AggregateProperty(Property, Aggregate):
    pass


def operands(parts: list[Calculator], snap: Snapshot) -> list[list[Column]]:
    """Aggregates and constants as they are; what has its own scope or plan as scalar subqueries."""
    return [p.columns(snap) if isinstance(p, Aggregate) else p.scalars(snap) for p in parts]


def broadcast(values: list[list[Column]], fn: Callable[..., Column]) -> list[Column]:
    n = max(map(len, values))
    if any(len(v) not in (1, n) for v in values):
        raise ValueError("vectors of different lengths")
    return [fn(*[v[i if len(v) > 1 else 0] for v in values]) for i in range(n)]


class Constant(AggregateProperty):
    def __init__(self, number: float):
        self.number = number

    def columns(self, snap: Snapshot) -> list[Column]:
        return [F.lit(self.number)]

    def signature(self) -> Any:
        return ("Constant", self.number)


class Lambda(AggregateProperty):
    """``function(snapshot) -> aggregate Column``."""

    def __init__(self, function: Callable[[Snapshot], Column]):
        self.function = function

    def columns(self, snap: Snapshot) -> list[Column]:
        return [self.function(snap)]

    def signature(self) -> Any:
        return ("Lambda", signature_of(self.function))


class _Nested(AggregateProperty):
    """Any calculator as an operand."""

    def __init__(self, inner: Calculator):
        self.inner, self.outputs = inner, inner.outputs

    def dependencies(self) -> list[Calculator]:
        return [self.inner]

    def columns(self, snap: Snapshot) -> list[Column]:
        return self.inner.scalars(snap)

    def signature(self) -> Any:
        return ("Nested", signature_of(self.inner))


def as_property(x: Any) -> Calculator:
    if isinstance(x, Property):
        return x
    if isinstance(x, Calculator):
        return _Nested(x)
    if is_number(x):
        return Constant(float(x))
    if callable(x):
        return Lambda(x)
    raise TypeError(f"{x!r} is no calculator, number or callable")


class Op(AggregateProperty):
    def __init__(self, op: str, parts: list[Calculator]):
        self.op, self.parts = op, parts
        self.outputs = max((p.outputs for p in parts), key=len)

    @classmethod
    def of(cls, op: str, parts: list[Calculator]) -> Calculator:
        """Sums and products of sums and products are flattened; of constants alone they are folded."""
        if op in ("add", "mul"):
            parts = [q for p in parts for q in (p.parts if isinstance(p, Op) and p.op == op else [p])]
            if all(isinstance(p, Constant) for p in parts):
                out = parts[0].number
                for p in parts[1:]:
                    out = getattr(operator, op)(out, p.number)
                return Constant(out)
        return cls(op, parts)

    def dependencies(self) -> list[Calculator]:
        return self.parts

    def columns(self, snap: Snapshot) -> list[Column]:
        values = operands(self.parts, snap)
        if self.op in _UNARY:
            return broadcast(values, _UNARY[self.op])
        out = values[0]
        for v in values[1:]:
            out = broadcast([out, v], _BINARY[self.op])
        return out

    def frame(self, snap: Snapshot) -> DataFrame:
        return Aggregate.frame(self, snap)

    def signature(self) -> Any:
        return (self.op, signature_of(self.parts))


class Clip(AggregateProperty):
    def __init__(self, inner: Calculator, vmin: Any, vmax: Any):
        self.inner, self.outputs = inner, inner.outputs
        self.vmin, self.vmax = (None if v is None else as_property(v) for v in (vmin, vmax))

    def columns(self, snap: Snapshot) -> list[Column]:
        low, high = (None if v is None else operands([v], snap)[0][0] for v in (self.vmin, self.vmax))
        return [clip(c, low, high) for c in operands([self.inner], snap)[0]]

    def signature(self) -> Any:
        return ("Clip", signature_of((self.inner, self.vmin, self.vmax)))
