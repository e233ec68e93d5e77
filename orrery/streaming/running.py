from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.core import Aggregate
from ..snapshot import Snapshot


def running(snap: Snapshot, parts: dict[str, Aggregate], by: str = "family") -> DataFrame:
    """The aggregates so far by ``by``; start it with output mode "complete" or "update". State is one row a group."""
    columns = [c.alias(n if len(p.outputs) == 1 else f"{n}_{o}") for n, p in parts.items() for c, o in zip(p.columns(snap), p.outputs, strict=True)]
    return snap.df.groupBy(by).agg(*columns)
