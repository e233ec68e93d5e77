"""Calculators: immutable nodes that become one Catalyst plan.

An ``Aggregate`` is a list of aggregate columns, so any number of them over one scope share a
single ``agg``. Other calculators plan a frame of one row themselves. A calculator inside a
parameter becomes an uncorrelated scalar subquery of the same plan.
"""

from __future__ import annotations

import dataclasses
import hashlib
import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..snapshot import Snapshot
from ..units import Unit, in_units, is_number
from .result import Clock, ErrorPolicy, Result, RunOptions, Status


class CalculatorError(RuntimeError):
    pass


class CycleError(CalculatorError):
    pass


@dataclasses.dataclass(frozen=True)
class Context:
    """What a parameter that is a callable of two arguments gets beside the snapshot."""

    snap: Snapshot

    def value(self, calculator: Calculator) -> Any:
        return calculator(self.snap)

    def column(self, calculator: Calculator) -> Column:
        """The calculator as a subquery: no job is run."""
        return calculator.scalars(self.snap)[0]


def called(fn: Callable, snap: Snapshot) -> Any:
    """``fn(snap)``, or ``fn(context, snap)`` if it takes two arguments."""
    try:
        needed = [p for p in inspect.signature(fn).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty]
    except (TypeError, ValueError):
        needed = []
    return fn(Context(snap), snap) if len(needed) == 2 else fn(snap)


def is_dynamic(param: Any) -> bool:
    """Whether a parameter's value depends on the snapshot."""
    if isinstance(param, dict):
        param = list(param.values())
    return any(map(is_dynamic, param)) if isinstance(param, (list, tuple)) else isinstance(param, Calculator) or (callable(param) and not isinstance(param, Column))


def resolved(param: Any, snap: Snapshot, unit: Unit | str | None = None) -> Any:
    """A parameter for a snapshot: containers member by member, what is dynamic as columns, anything else as it is."""
    if isinstance(param, dict):
        return {k: resolved(v, snap, unit) for k, v in param.items()}
    if isinstance(param, (list, tuple)):
        return type(param)(resolved(v, snap, unit) for v in param)
    return value_of(param, snap, unit) if is_dynamic(param) else param


class ParamView:
    """The resolved parameters of a calculator, by attribute or by name."""

    def __init__(self, values: dict[str, Any]):
        self._values = values

    def __getattr__(self, name: str) -> Any:
        try:
            return self._values[name]
        except KeyError:
            raise AttributeError(name) from None

    def __getitem__(self, name: str) -> Any:
        return self._values[name]

    def __iter__(self):
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)


def value_of(param: Any, snap: Snapshot, unit: Unit | str | None = None) -> Column:
    """A scalar parameter as a column: number, text with a unit, calculator, callable (of the snapshot, or of context and snapshot) or column."""
    if isinstance(param, Column):
        return param
    if isinstance(param, Calculator):
        return param.scalars(snap)[0]
    if is_number(param) or isinstance(param, (str, Unit)):
        return F.lit(in_units(param, unit))
    if callable(param):
        return value_of(called(param, snap), snap, unit)
    raise TypeError(f"{param!r} is no number, unit, calculator or callable")


def vector_of(param: Any, snap: Snapshot, unit: Unit | str | None = None) -> list[Column]:
    if isinstance(param, Calculator):
        return param.scalars(snap)
    if callable(param) and not isinstance(param, Column):
        return vector_of(called(param, snap), snap, unit)
    return [value_of(p, snap, unit) for p in param]


def signature_of(x: Any) -> Any:
    if isinstance(x, (Calculator, Scope)) or hasattr(x, "signature"):
        return x.signature()
    if isinstance(x, (list, tuple)):
        return tuple(map(signature_of, x))
    if isinstance(x, dict):
        return tuple((k, signature_of(v)) for k, v in x.items())
    return repr(x) if not callable(x) else f"{getattr(x, '__qualname__', x)}@{id(x):x}"


class Calculator:
    """Base of all nodes. ``outputs`` names the columns of its one row."""

    outputs: tuple[str, ...] = ("value",)
    name: str | None = None

    # what subclasses define
    def frame(self, snap: Snapshot) -> DataFrame:
        raise NotImplementedError

    def public(self, row: Row) -> Any:
        return row[0] if len(row) == 1 else tuple(row)

    def dependencies(self) -> list[Calculator]:
        """Calculators among the parameters, in containers too."""

        def inside(v: Any) -> list[Calculator]:
            if isinstance(v, dict):
                v = list(v.values())
            return [c for x in v for c in inside(x)] if isinstance(v, (list, tuple)) else [v] if isinstance(v, Calculator) else []

        return [c for v in vars(self).values() for c in inside(v)]

    def params(self, snap: Snapshot) -> ParamView:
        """The parameters as they are for a snapshot."""
        return ParamView({f.name: resolved(getattr(self, f.name), snap) for f in (dataclasses.fields(self) if dataclasses.is_dataclass(self) else ())})

    def has_dynamic_param(self) -> bool:
        return any(is_dynamic(v) for v in vars(self).values())

    def scope(self) -> Scope:
        return Scope()

    def core(self) -> Calculator:
        return self

    # composition
    def filter(self, *filters: Any) -> Bound:
        return Bound(self, Scope(filters=filters))

    def transform(self, *transforms: Any) -> Bound:
        return Bound(self, Scope(transforms=transforms))

    with_filter, with_transformation = filter, transform

    def named(self, name: str) -> Calculator:
        out = _copy(self)
        out.__dict__["name"] = name
        return out

    def __and__(self, other: Calculator) -> Combined:
        return Combined([*_flat(self), *_flat(other)])

    # identity
    def signature(self) -> Any:
        own = dataclasses.fields(self) if dataclasses.is_dataclass(self) else ()
        return (type(self).__name__, *((f.name, signature_of(getattr(self, f.name))) for f in own))

    def signature_hash(self) -> str:
        return hashlib.sha256(repr(self.signature()).encode()).hexdigest()[:12]

    def label(self) -> str:
        return self.name or type(self).__name__

    # running
    def scalars(self, snap: Snapshot) -> list[Column]:
        """The outputs as scalar subqueries."""
        frame = self.frame(snap)
        row = frame.select(F.struct(*frame.columns).alias("row")).scalar()
        return [row[c] for c in frame.columns]

    def check(self, above: tuple[int, ...] = ()) -> None:
        if id(self) in above:
            raise CycleError(f"{self.label()} depends on itself")
        for d in self.dependencies():
            d.check((*above, id(self)))

    def run(self, snap: Snapshot, options: RunOptions | None = None) -> Result:
        options = options or RunOptions()
        self.check()
        snap.df.sparkSession.sparkContext.setJobDescription(f"{self.label()} {self.signature_hash()}")
        out = Result(self.label(), signature=self.signature_hash())
        with Clock() as clock:
            try:
                out.value, out.cached = options.kept(snap, self.signature_hash(), lambda: self.public(self.frame(snap).first()))
            except Exception as error:
                if ErrorPolicy(options.errors) is ErrorPolicy.RAISE:
                    raise
                out.status, out.error = Status.FAILED, error
        out.seconds = clock.seconds
        out.parts = [Result(d.label(), signature=d.signature_hash()) for d in self.dependencies()] if options.record == "all" else []
        options.tell("run", f"{out.name}: {out.status.value} in {out.seconds * 1e3:.1f} ms")
        return out

    def __call__(self, snap: Snapshot) -> Any:
        return self.run(snap).value

    value = __call__

    def format_tree(self, depth: int = 0) -> str:
        return "\n".join(["  " * depth + self.label(), *(d.format_tree(depth + 1) for d in self.dependencies())])

    def format_flow(self) -> str:
        """The steps of a run in order: what is depended on, transforms, filters, the calculation."""
        lines: list[str] = []

        def visit(c: Calculator) -> None:
            for d in c.core().dependencies():
                visit(d)
            scope = c.scope()
            steps = [*(f"transform {type(t).__name__}" for t in scope.transforms), *(f"filter {type(f).__name__}" for f in scope.filters), f"calculate {c.core().label()}"]
            if (line := " -> ".join(steps)) not in lines:
                lines.append(line)

        visit(self)
        return "\n".join(lines)

    def explain(self, snap: Snapshot, mode: str = "formatted") -> None:
        self.frame(snap).explain(mode)


def _copy(c: Calculator) -> Calculator:
    out = object.__new__(type(c))
    out.__dict__.update(c.__dict__)
    return out


def _flat(c: Calculator) -> list[Calculator]:
    return list(c.parts) if isinstance(c, Combined) else [c]


class Aggregate(Calculator):
    """A calculator that is aggregate columns over the rows of its scope."""

    def columns(self, snap: Snapshot) -> list[Column]:
        raise NotImplementedError

    def frame(self, snap: Snapshot) -> DataFrame:
        return snap.df.agg(*[c.alias(n) for c, n in zip(self.columns(snap), self.outputs, strict=True)])


@dataclasses.dataclass(frozen=True)
class Scope:
    """Transforms, in order, then filters, all of which must hold."""

    transforms: tuple[Any, ...] = ()
    filters: tuple[Any, ...] = ()

    def then(self, inner: Scope) -> Scope | None:
        """This scope with another inside it, or None if it takes two: a filter comes before a transform."""
        if self.filters and inner.transforms:
            return None
        return Scope(self.transforms + inner.transforms, self.filters + inner.filters)

    def apply(self, snap: Snapshot) -> Snapshot:
        for t in self.transforms:
            snap = t.apply(snap)
        for f in self.filters:
            snap = snap.where(f.mask(snap))
        return snap

    def signature(self) -> Any:
        return ("Scope", signature_of(self.transforms), signature_of(self.filters))

    def __call__(self, calculator: Calculator) -> Bound:
        return Bound(calculator, self)


class Bound(Calculator):
    """A calculator in a scope. An enclosing scope is applied before the one it encloses."""

    def __init__(self, base: Calculator, scope: Scope):
        if isinstance(base, Bound) and (one := scope.then(base._scope)) is not None:
            base, scope = base.base, one
        self.base, self._scope = base, scope
        self.outputs = base.outputs
        self.name = base.name

    def scope(self) -> Scope:
        return self._scope

    def core(self) -> Calculator:
        return self.base

    def filter(self, *filters: Any) -> Bound:
        return Bound(self.base, dataclasses.replace(self._scope, filters=self._scope.filters + filters))

    def transform(self, *transforms: Any) -> Bound:
        return Bound(self.base, dataclasses.replace(self._scope, transforms=self._scope.transforms + transforms))

    with_filter, with_transformation = filter, transform

    def frame(self, snap: Snapshot) -> DataFrame:
        return self.base.frame(self._scope.apply(snap))

    def public(self, row: Row) -> Any:
        return self.base.public(row)

    def signature(self) -> Any:
        return ("Bound", signature_of(self.base), self._scope.signature())

    def label(self) -> str:
        return self.name or f"{self.base.label()} in scope"


class Combined(Calculator):
    """Several calculators, whose values come as a tuple."""

    def __init__(self, parts: list[Calculator]):
        self.parts = parts
        self.outputs = tuple(f"{i}_{o}" for i, p in enumerate(parts) for o in p.outputs)

    def dependencies(self) -> list[Calculator]:
        return self.parts

    def frame(self, snap: Snapshot) -> DataFrame:
        return fused(snap, {str(i): p for i, p in enumerate(self.parts)})

    def public(self, row: Row) -> Any:
        return split(row, {str(i): p for i, p in enumerate(self.parts)}, tuple)

    def signature(self) -> Any:
        return ("Combined", signature_of(self.parts))


def groups(parts: dict[str, Calculator]) -> list[tuple[Scope, dict[str, Aggregate]] | tuple[None, dict[str, Calculator]]]:
    """Aggregates by scope; every other calculator alone."""
    by_scope: dict[Any, tuple[Scope, dict[str, Aggregate]]] = {}
    alone: list = []
    for name, p in parts.items():
        if isinstance(p.core(), Aggregate):
            by_scope.setdefault(p.scope().signature(), (p.scope(), {}))[1][name] = p.core()
        else:
            alone.append((None, {name: p}))
    return [*by_scope.values(), *alone]


def group_frame(snap: Snapshot, scope: Scope | None, members: dict[str, Calculator]) -> DataFrame:
    if scope is None:
        (name, p), *_ = members.items()
        return p.frame(snap).toDF(*[f"{name}_{o}" for o in p.outputs])
    inner = scope.apply(snap)
    return inner.df.agg(*[c.alias(f"{name}_{o}") for name, p in members.items() for c, o in zip(p.columns(inner), p.outputs, strict=True)])


def fused(snap: Snapshot, parts: dict[str, Calculator]) -> DataFrame:
    """One row with the outputs of all parts: one ``agg`` for each scope; frames of one row are put side by side."""
    frames = [group_frame(snap, scope, members) for scope, members in groups(parts)]
    out = frames[0]
    for i, f in enumerate(frames[1:]):
        out = out.select("*", f.select(F.struct(*f.columns).alias("row")).scalar().alias(f"_row{i}")).select("*", f"_row{i}.*").drop(f"_row{i}")
    return out.select(*[f"{name}_{o}" for name, p in parts.items() for o in p.outputs])


def split(row: Row, parts: dict[str, Calculator], kind: Callable) -> Any:
    values = [p.core().public(Row(*[row[f"{name}_{o}"] for o in p.outputs])) for name, p in parts.items()]
    return kind(values)
