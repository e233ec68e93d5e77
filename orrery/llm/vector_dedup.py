"""Embedding near-dedup through a pivot-permutation index.

A vector is described by its ``prefix`` nearest pivots, in order of nearness. Pivots are a
bounded sample of the vectors of its length, about 4 sqrt(N) of them and at most
``pivot_bytes`` in all. Each pivot has an inverted list of the vectors it describes; vectors
that share ``shared`` pivots or more (all, if there are fewer pivots) are candidates, and a
candidate becomes a link if its cosine, in double precision, reaches ``least``. Vectors of each
of the ``lengths`` commonest lengths have pivots of their own; those of any other length are
one list.

Equal vectors are one class and compared once. A pair is counted in the list of its least
shared pivot only. A list of more than ``split`` vectors is divided by their other pivots, and
a pair is counted under the two least it shares, so lists stay short as N grows. What is
longer than ``block`` still is cut into blocks, and each pair of blocks is a unit of work, so
no task holds more than two blocks whatever the data. Units give numbers of links and the ties
that hold components together, never all pairs.

Defined results: a vector that is null, of length 0, all zero, or that has null or non-finite
components links with nothing, and vectors of different lengths don't link; rows that share an
id are vectors of their own, in links and in components, which take the least id they hold; a
null id is the least id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import ship, stage

NO_ID = -(2**63)
#: Sizes of so many long lists (20 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_LISTS = 400_000


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pack(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, ok, data``: the vector as doubles scaled to a largest component of 1 (so that no square overflows), and whether it can be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null is NaN
            ends = np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            ok, data, at = [], [], 0
            for end in ends.tolist():
                x = flat[at:end]
                at = end
                top = np.abs(x).max() if len(x) else 0.0  # NaN if any is
                good = bool(0 < top < np.inf)
                ok.append(good)
                data.append((x / top + 0.0).astype("<f8").tobytes() if good else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_()), pa.array(data, pa.binary())], names=["id", "ok", "data"])

    ship(table.sparkSession)
    ids = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id")
    return table.select(ids, F.col(f"`{vector_col}`").cast("array<double>").alias("v")).mapInArrow(run, "id long, ok boolean, data binary")


def _apart(points: np.ndarray) -> np.ndarray:
    """Of pivots near each other the first stays: else a large group of near copies has many alike, and its members' lists differ by chance."""
    kept = np.empty((0, points.shape[1]))
    for lo in range(0, len(points), 1024):
        part = points[lo : lo + 1024]
        part = part[~(part @ kept.T > 0.9).any(1)] if len(kept) else part
        part = part[~np.tril(part @ part.T > 0.9, -1).any(1)]
        kept = np.concatenate([kept, part])
    return kept


def choose_pivots(classes: DataFrame, lengths: int, pivot_bytes: int) -> dict[int, np.ndarray]:
    """The pivots of each of the commonest lengths (in bytes), from ``key, data``: those of least key."""
    most = classes.groupBy(F.length("data").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(lengths).collect()
    if not most:
        return {}
    wanted = {r["w"]: min(pivot_bytes // len(most) // r["w"], max(16, math.isqrt(16 * r["n"]))) for r in most}
    # A threshold on the key lets about twice as many through, so that the driver gets no more.
    below = F.lit(False)
    for r in most:
        share = min(1.0, 2 * wanted[r["w"]] / r["n"] + 16 / r["n"])
        below = below | ((F.length("data") == r["w"]) & (F.col("key") <= min(int(-(2**63) + 2**64 * share), 2**63 - 1)))
    found: dict[int, list[tuple[int, bytes]]] = {w: [] for w in wanted}
    for r in classes.where(below).select("key", "data").collect():
        found[len(r["data"])].append((r["key"], bytes(r["data"])))
    return {w: _apart(_unit([d for _, d in sorted(v)[: wanted[w]]])) for w, v in found.items() if v}


def near_vectors(table: DataFrame, *, least: float = 0.95, prefix: int = 10, shared: int = 2, split: int = 16_384, block: int = 2048, lengths: int = 8, pivot_bytes: int = 32_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n_links, component_id`` for each row."""
    spark = table.sparkSession
    rows = stage(pack(table, id_col, vector_col).withColumn("key", F.when(F.col("ok"), F.xxhash64("data"))), "vectors")
    classes = stage(rows.where("ok").groupBy("key", "data").agg(F.min("id").alias("cid"), F.count("*").alias("copies")), "vector_classes")
    points = choose_pivots(classes, lengths, pivot_bytes)
    first = dict(zip(points, np.cumsum([0, *map(len, points.values())]).tolist(), strict=False))
    chosen = spark.sparkContext.broadcast(points)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = pa.compute.binary_length(b.column(2)).to_numpy()
            for w in np.unique(width).tolist():
                part = b.take(pa.array(np.flatnonzero(width == w)))
                p = chosen.value.get(w)
                k = 1 if p is None else min(prefix, len(p))
                near = np.full((part.num_rows, k), -w, "<i4")  # a length without pivots is one list
                if p is not None:
                    step = max(1, 4_000_000 // len(p))
                    for lo in range(0, part.num_rows, step):
                        near[lo : lo + step] = np.argsort(-(_unit(part.column(2)[lo : lo + step].to_pylist()) @ p.T), axis=1, kind="stable")[:, :k] + first[w]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k), pa.int32()), pa.array(near.ravel(), pa.int32()))
                need = pa.array(np.full(part.num_rows, min(shared, k), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists, need], names=["key", "copies", "data", "pivots", "needed"])

    described = stage(classes.select("key", "copies", "data").mapInArrow(describe, "key long, copies long, data binary, pivots array<int>, needed int"), "described")
    held = described.select("needed", F.explode("pivots").alias("pivot")).groupBy("pivot", "needed").agg(F.count("*").alias("held"))
    long_ones = held.where((F.col("held") > split) & (F.col("needed") >= 2)).select("pivot", F.lit(True).alias("long"))  # a row a pivot: bounded
    listed = described.select("*", F.explode("pivots").alias("pivot")).join(F.broadcast(long_ones), "pivot", "left")
    seconds = F.when(F.col("long"), F.filter("pivots", lambda p: p > F.col("pivot"))).otherwise(F.array(F.lit(-1)))
    listed = listed.select("pivot", F.explode(seconds).alias("second"), "key", "copies", "data", "pivots", "needed")
    sizes = stage(listed.groupBy("pivot", "second").agg(F.count("*").alias("held")).where(F.col("held") > block), "long_lists")
    sizes = sizes.select("pivot", "second", F.ceil(F.col("held") / block).cast("int").alias("blocks"))
    listed = listed.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LISTS else sizes, ["pivot", "second"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod("key", F.col("blocks")).cast("int")
    units = listed.select("pivot", "second", "key", "copies", "data", "pivots", "needed", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("pivot", "second", "key", "copies", "data", "pivots", "needed", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(t: pa.Table) -> pa.Table:
        pivot, second, lo, hi = (t.column(c)[0].as_py() for c in ("pivot", "second", "lo", "hi"))
        order = np.lexsort((t.column("key").to_numpy(), t.column("own").to_numpy()))
        t = t.take(pa.array(order))
        own, key, copies = t.column("own").to_numpy(), t.column("key").to_numpy(), t.column("copies").to_numpy()
        x, near, needed = _unit(t.column("data").to_pylist()), np.array(t.column("pivots").to_pylist()), int(t.column("needed")[0].as_py())
        names, at = np.unique(near, return_inverse=True)
        held = np.zeros((len(x), len(names)), np.float32)
        np.put_along_axis(held, at.reshape(near.shape), 1.0, 1)
        # The pair is counted here if these are the least pivots it shares.
        before = held[:, names < (pivot if second < 0 else second)]
        earlier = 0 if second < 0 else 1
        links, root, a, b = np.zeros(len(x), np.int64), np.arange(len(x)), [], []
        left = np.flatnonzero(own == lo)
        for i in range(0, len(left), 512):
            part = left[i : i + 512]
            right = np.flatnonzero(own == hi) if lo != hi else np.arange(part[0], len(x))
            ok = held[part] @ held[right].T >= needed
            if before.shape[1]:
                ok &= before[part] @ before[right].T == earlier
            if lo == hi:
                ok &= part[:, None] < right[None, :]
            cosine = x[part] @ x[right].T
            for p, q in zip(*np.nonzero(ok & (np.abs(cosine - least) < 1e-9)), strict=True):
                cosine[p, q] = math.fsum(x[part[p]] * x[right[q]])  # products of matrices may be off by a last place
            ok &= cosine >= least
            links[part] += ok @ copies[right]
            links[right] += ok.T @ copies[part]
            for p in np.flatnonzero(ok.any(1)):
                met = right[ok[p]]
                roots, once = np.unique(root[met], return_index=True)
                for q in met[once[roots != root[part[p]]]]:
                    a.append(key[part[p]])
                    b.append(key[q])
                roots = np.append(roots, root[part[p]])
                root[np.isin(root, roots)] = roots.min()
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(np.concatenate([key[some], np.array(a, np.int64)]), pa.int64()), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())]), "n": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]), pa.int64())})

    met = stage(units.groupBy("pivot", "second", "lo", "hi").applyInArrow(compare, "a long, b long, n long"), "vector_links")
    links = met.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    found = components(met.where("b is not null").select("a", "b"))
    named = classes.select("key", "cid", "copies").join(links, "key", "left").join(found.select(F.col("id").alias("key"), "root"), "key", "left")
    # A component is told by its least key and named by its least id.
    least_ids = named.where("root is not null").groupBy("root").agg(F.min("cid").alias("least"))
    named = named.join(least_ids, "root", "left").select("key", "copies", "n", F.coalesce("least", "cid").alias("least"))
    out = rows.select("id", "key").join(named, "key", "left")
    back = lambda c: F.when(c != NO_ID, c)
    return out.select(back(F.col("id")).alias("id"), F.coalesce(F.coalesce("n", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), back(F.coalesce("least", "id")).alias("component_id"))
