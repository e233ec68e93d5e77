"""Many named calculators at once: one ``agg``, and one job, for each scope they share."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row

from ..snapshot import Snapshot
from .core import Calculator, fused, group_frame, groups, signature_of, split
from .result import Clock, ErrorPolicy, Result, RunOptions, Status


class Pipeline(Calculator):
    def __init__(self, parts: dict[str, Calculator]):
        if not parts:
            raise ValueError("a pipeline has at least one calculator")
        named: dict[str, Any] = {}
        for key, p in parts.items():
            own = p.name or key
            if own in named and named[own] != signature_of(p):
                raise ValueError(f"two different calculators are named {own!r}")
            named[own] = signature_of(p)
        self.parts = dict(parts)
        self.outputs = tuple(f"{n}_{o}" for n, p in parts.items() for o in p.outputs)

    def dependencies(self) -> list[Calculator]:
        return list(self.parts.values())

    def frame(self, snap: Snapshot) -> DataFrame:
        return fused(snap, self.parts)

    def public(self, row: Row) -> dict[str, Any]:
        return dict(zip(self.parts, split(row, self.parts, list), strict=True))

    def signature(self) -> Any:
        return ("Pipeline", signature_of(self.parts))

    def run(self, snap: Snapshot, options: RunOptions | None = None) -> Result:
        options = options or RunOptions()
        self.check()
        policy = ErrorPolicy(options.errors)
        out = Result(self.label(), value={}, signature=self.signature_hash())
        with Clock() as clock:
            for scope, members in groups(self.parts):
                with Clock() as own:
                    error, values = None, dict.fromkeys(members)
                    try:
                        snap.df.sparkSession.sparkContext.setJobDescription(", ".join(members))
                        row = group_frame(snap, scope, members).first()
                        values = {n: p.core().public(Row(*[row[f"{n}_{o}"] for o in p.outputs])) for n, p in members.items()}
                    except Exception as found:
                        if policy is ErrorPolicy.RAISE:
                            raise
                        error = found
                for n, v in values.items():
                    out.parts.append(Result(n, v, self.parts[n].signature_hash(), Status.FAILED if error else Status.OK, error, own.seconds))
                    options.tell("node", f"{n}: {'failed' if error else 'ok'} in {own.seconds * 1e3:.1f} ms")
        values = {p.name: p.value for p in out.parts}
        failed = any(p.error for p in out.parts)
        out.value = {n: values[n] for n in self.parts} if not failed or policy is ErrorPolicy.COLLECT_PARTIAL else None
        out.status, out.seconds = Status.FAILED if failed else Status.OK, clock.seconds
        options.tell("run", f"{out.name}: {out.status.value} in {out.seconds * 1e3:.1f} ms, {len(out.parts)} nodes")
        return out
