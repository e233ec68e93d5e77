"""Percentiles by a mergeable summary and one exact pass.

In the first pass each task sorts what it has read, group by group, and keeps some hundred
cuts: (value before, value, weight between). Cuts of all tasks together bound the rank of any
value from below and from above, whatever the distribution, so for each wanted rank they give
an interval of values that holds it and few rows besides. In the second pass rows in such
intervals are summed by value, all others by the gap they are in; in order of value these sums
are prefix sums, of which the wanted ones are exact. Any number of fields, groups and ranks
takes these two passes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Cuts of a group in a task's summary, and rows that are summarised at a time.
CUTS, ROWS = 400, 500_000
#: Of the whole weight: how much further bounds reach, for the last places of sums.
SLACK = 1e-9
INF = float("inf")


@dataclass(frozen=True)
class Rank:
    """A wanted place in a field's order: by ``share`` (of the weights' sum less the first weight, which counts in front), or by number of rows, as ``of`` times their number over ``parts``, rounded down."""

    field: int
    share: float = 0.0
    of: int | None = None
    parts: int = 1


def number(v: float) -> str:
    """A double in SQL; columns of many numbers are made of text in one go."""
    return f"double('{v}')" if v in (INF, -INF) else f"{float(v)!r}D"


def summarized(group: np.ndarray, value: np.ndarray, weight: np.ndarray, cuts: int = CUTS) -> tuple[np.ndarray, ...]:
    """Events ``group, value, below, reached, first``: a stretch's weight counts as reached at its last value, and is below values past the one before it; ``first`` is the least weight at a group's least value."""
    if not len(group):
        return group, *[np.zeros(0)] * 4
    g, v, w, least = collapsed(group, value, weight)
    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(head, len(g)))
    run = np.cumsum(np.abs(w))
    before = np.repeat(run[head] - np.abs(w[head]), size)
    total = np.repeat(run[head + size - 1] - (run[head] - np.abs(w[head])), size)
    stretch = np.minimum((run - np.abs(w) - before) / np.where(total > 0, total, 1) * cuts, cuts - 1).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (stretch[1:] != stretch[:-1])]))
    end = np.append(start[1:], len(g)) - 1
    weights = np.add.reduceat(w, start)
    past = np.where(np.isin(start, head), -INF, v[start - 1])
    zero, none = np.zeros(len(start)), np.full(len(start), np.nan)
    return (
        np.concatenate([g[end], g[start], g[head]]), np.concatenate([v[end], past, v[head]]), np.concatenate([zero, weights, np.zeros(len(head))]),
        np.concatenate([weights, zero, np.zeros(len(head))]), np.concatenate([none, none, least[head]]),
    )


def _by_field(rows: DataFrame, n: int, weighted: bool, make: Callable, schema: str) -> DataFrame:
    """``make(f, group, value, weight)`` gives the columns of ``schema`` after the field's number, for up to ROWS rows of a task at a time; values are no NaN. ``rows``: ``g, f0, f1, ..., w``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        t = t.filter(pc.is_valid(t["g"]))
        g = t["g"].to_numpy()
        w = np.nan_to_num(t["w"].to_numpy()) if weighted else np.ones(len(g))
        for f in range(n):
            v = t[f"f{f}"].to_numpy()
            ok = ~np.isnan(v)
            out = make(f, g[ok], v[ok], w[ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out[0]), f, np.int32)), pa.array(out[0].astype(np.int32)), *[pa.array(x, from_pandas=True) for x in out[1:]]], names=["f", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                yield from made(held)
                held, size = [], 0
        if held:
            yield from made(held)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"f int, {schema}")


def collapsed(group: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups and values in order, each once: ``group, value``, the sum of its weights and the least of them."""
    by = np.lexsort((weight, value, group))
    g, v, w = group[by], value[by], weight[by]
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])]))
    return g[new], v[new], np.add.reduceat(w, new), w[new]


def near_targets(group: np.ndarray, value: np.ndarray, weight: np.ndarray, ends: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """``group, gap, k, t, first, most``: sums of the values in the intervals from ``ends`` (lows and highs by group), each by itself, and of all others by the gap they are in (k: NaN)."""
    if not len(group):
        return (group, group.astype(np.int32), *[np.zeros(0)] * 4)
    g, v, w, least = collapsed(group, value, weight)
    gap, inside = np.zeros(len(g), np.int32), np.zeros(len(g), bool)
    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    for lo, hi in zip(head, np.append(head[1:], len(g)), strict=True):
        lows, highs = ends.get(int(g[lo]), (np.zeros(0), np.zeros(0)))
        gap[lo:hi] = np.searchsorted(lows, v[lo:hi])
        inside[lo:hi] = gap[lo:hi] > np.searchsorted(highs, v[lo:hi])
    start = np.flatnonzero(np.concatenate([[True], inside[1:] | (inside[1:] != inside[:-1]) | (g[1:] != g[:-1]) | (gap[1:] != gap[:-1])]))
    last = np.append(start[1:], len(g)) - 1
    return g[start], gap[start], np.where(inside[start], v[start], np.nan), np.add.reduceat(w, start), np.minimum.reduceat(least, start), v[last]


def bounds(rows: DataFrame, ranks: Sequence[Rank], fields: int, weighted: bool) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(group, number of the rank) -> (target, low, high): the value with which the target is reached is above ``low`` and not above ``high``. A row for each on the driver."""
    events = _by_field(rows, fields, weighted, lambda f, *columns: summarized(*columns), "g int, v double, below double, reached double, first double").groupBy("g", "f", "v").agg(F.sum("below").alias("below"), F.sum("reached").alias("reached"), F.min("first").alias("first"))
    of = Window.partitionBy("g", "f")
    upto = of.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    events = events.select(
        "g", "f", "v", F.sum("reached").over(upto).alias("reached"), (F.sum("below").over(upto) - F.col("below")).alias("below"), F.sum("reached").over(of).alias("total"),
        F.min(F.when(F.col("first").isNotNull(), F.struct("v", "first"))).over(of)["first"].alias("one"),
    )
    wanted = ", ".join(f"named_struct('i', {i}, 'field', {r.field}, 'share', {number(r.share)}, 'of', {'null' if r.of is None else number(r.of)}, 'parts', {number(r.parts)})" for i, r in enumerate(ranks))
    each = events.withColumn("r", F.expr(f"explode(filter(array({wanted}), r -> r.field = f))")).select("*", F.col("r.i").alias("i"))
    share, of_all, total = F.col("r.share"), F.col("r.of"), F.col("total")
    by_number = F.least(F.floor(total * of_all / F.col("r.parts")), total - 1) + 1
    each = each.withColumn("t", F.when(of_all.isNotNull(), by_number).otherwise(F.col("one") + share * (total - F.col("one")))).withColumn("slack", F.abs("total") * SLACK)
    out = each.groupBy("g", "i").agg(
        F.max("t").alias("t"), F.max(F.when(F.col("below") < F.col("t") - F.col("slack"), F.col("v"))).alias("low"),
        F.coalesce(F.min(F.when(F.col("reached") >= F.col("t") + F.col("slack"), F.col("v"))), F.max("v")).alias("high"),
    )
    return {(r["g"], r["i"]): (r["t"], r["low"], r["high"]) for r in out.collect()}


def merged(intervals: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Half-open intervals (low, high], those that meet made one."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def ranked(rows: DataFrame, group: Column, fields: Sequence[Column], ranks: Sequence[Rank], weight: Column | None = None, linear: bool = True, groups: int = 1) -> DataFrame:
    """``g, i, at``: for each group (0 to ``groups`` - 1; others are left out) and rank the value there, in linear interpolation between values or the value that reaches it. Null and NaN are left out, and so are groups without values."""
    plain = rows.select(group.cast("int").alias("g"), *[c.cast("double").alias(f"f{i}") for i, c in enumerate(fields)], *([] if weight is None else [weight.cast("double").alias("w")]))
    # The group may be a long expression: it is not asked for in filters, which would repeat it.
    found = {k: v for k, v in bounds(plain, ranks, len(fields), weight is not None).items() if 0 <= k[0] < groups}
    near, targets = defaultdict(list), defaultdict(list)
    for (g, i), (target, low, high) in found.items():
        near[g, ranks[i].field].append((-INF if low is None else low, high))
        targets[g, ranks[i].field].append(f"named_struct('i', {i}, 't', {number(target)})")
    ends: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in fields]
    for (g, f), v in near.items():
        low_high = np.array(merged(v))
        ends[f][g] = low_high[:, 0], low_high[:, 1]
    sums = _by_field(plain, len(fields), weight is not None, lambda f, *columns: near_targets(*columns, ends[f]), "g int, gap int, k double, t double, first double, most double")
    sums = sums.groupBy("g", "f", "gap", "k").agg(F.sum("t").alias("t"), F.min("first").alias("first"), F.max("most").alias("most"))
    order = Window.partitionBy("g", "f").orderBy("most")
    sums = sums.withColumn("c", F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumns({"k0": F.lag("most").over(order), "was": F.coalesce(F.lag("c").over(order), F.lit(-INF)), "upto": F.when(F.lead("c").over(order).isNull(), INF).otherwise(F.col("c"))})
    mine = "get(get(array({}), f), g)".format(", ".join("array({})".format(", ".join(f"cast(array({', '.join(targets.get((g, f), []))}) as array<struct<i: int, t: double>>)" for g in range(groups))) for f in range(len(fields))))
    met = sums.where(F.col("k").isNotNull() & F.col("g").between(0, groups - 1)).withColumn("x", F.expr(f"explode(filter({mine}, x -> x.t > was and x.t <= upto))"))
    c0, k, k0, target = F.col("c") - F.col("t"), F.col("k"), F.col("k0"), F.col("x.t")
    between = k0 + (k - k0) * ((target - c0) / F.col("first"))
    value = F.when(k0.isNotNull() & (k0 > -INF) & (k < INF) & (F.col("first") > 0) & (c0 + F.col("first") >= target), between).otherwise(k) if linear else k
    return met.select("g", F.col("x.i").alias("i"), value.alias("at"))


def percentiles(rows: DataFrame, group: Column, fields: Sequence[Column], ranks: Sequence[Rank], weight: Column | None = None, groups: int = 1) -> DataFrame:
    """``ranked`` with a row for each group: ``g, r0, r1, ...``."""
    return ranked(rows, group, fields, ranks, weight, groups=groups).groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col("at"))).alias(f"r{i}") for i in range(len(ranks))])
