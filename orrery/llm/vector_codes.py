"""Product codes of vectors: each of a vector's parts becomes the index of its nearest codebook entry.

Components become integers, so every result is exact. Nearest entries are found in two steps.
One float32 matrix product gives all distances of a block, each with an interval that holds
the exact value whatever the order of the sum: a product of length d errs by at most
(d + 2) u / (1 - (d + 2) u) times the product of the norms, u = 2^-24. Only entries whose
interval reaches below the least upper end can be nearest; where there are several, they are
computed again in int64, and of equal ones the first index wins.

Codebooks are made by rounds of assignment and floor means. A round is one pass: tasks add
up their blocks in int64, Spark adds up the tasks, and what comes to the driver is the
codebooks themselves, whose size is a parameter. The integer vectors are staged once.

Defined results: vectors that are null or hold null or non-finite components are left out.
The first entries are those of the least ids, nulls last, of equal ids those whose staged bytes
come first. With fewer vectors than entries there are fewer entries. Vectors shorter than the longest, or
whose length is no multiple of the parts, are filled with zeros, which changes no distance.
Components beyond 2^24 in absolute value once scaled are set to it, so that distances stay
in 64 bits; vectors of more than 8,191 components are an error. Ids and labels may be null or repeated, every row has its own code; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import ship, stage

#: Unit roundoff of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53
#: Components are at most this large, so that they are exact in float32 and distances of 8,191 components stay in int64.
MOST, WIDEST = 2**24, 8191
BLOCK = 4096
#: Labels that hold at least this share of the rows are broadcast, so there are at most as many; the rest are joined by shuffle.
LABELS = 100_000


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -MOST, MOST).astype(np.int32)


def _quantize(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: float) -> DataFrame:
    """``id, label, v``: components as little-endian int32, rows with a bad component left out."""
    label = F.lit(None).cast("int") if label_col is None else F.col(f"`{label_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("v is not null")
    schema = T.StructType([rows.schema["id"], rows.schema["label"], T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)  # a null component is NaN here
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            with np.errstate(invalid="ignore", over="ignore"):
                data, good = scaled(np.nan_to_num(flat), scale), bad[ends[1:]] == bad[ends[:-1]]
            keep = np.flatnonzero(good)
            v = [data[ends[i] : ends[i + 1]].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep)), batch.column("label").take(pa.array(keep)), pa.array(v, pa.binary())], names=["id", "label", "v"])

    ship(vectors.sparkSession)
    return rows.mapInArrow(run, schema)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as rows of a matrix of int64, ``width`` wide."""
    for whole in batches:
        for lo in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(lo, BLOCK)
            rows = batch.column("v").to_pylist()
            yield batch, np.frombuffer(b"".join([r.ljust(4 * width, b"\0") for r in rows]), "<i4").reshape(len(rows), width).astype(np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the first of the rows of ``c`` at least squared distance; both are int64."""
    n, d = x.shape
    if len(c) == 1 or not n:
        return np.zeros(n, np.int64)
    gamma = (d + 2) * U32 / (1 - (d + 2) * U32)
    norm = lambda v: np.sqrt((v * v).sum(1).astype(np.float64)) * (1 + 4 * U64)
    nx, nc = norm(x), norm(c)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    square = (c * c).sum(1).astype(np.float64)
    # |x - c|^2 without |x|^2, which is the same for all entries.
    near = square - 2 * product
    radius = (2 * gamma * np.outer(nx, nc) + 4 * U64 * (square + 2 * np.abs(product))) * (1 + 16 * U64)
    open_ = near - radius <= (near + radius).min(1)[:, None]
    out = open_.argmax(1)
    unsure = np.flatnonzero(open_.sum(1) > 1)
    if len(unsure):
        row, entry = np.nonzero(open_[unsure])
        exact = np.full((len(unsure), len(c)), np.iinfo(np.int64).max)
        away = x[unsure[row]] - c[entry]
        exact[row, entry] = (away * away).sum(1)
        out[unsure] = exact.argmin(1)
    return out


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the rows of ``x`` by part, and their squared distances in all. ``books``: part, entry, position."""
    parts, _, d = books.shape
    codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
    for p in range(parts):
        own = x[:, p * d : (p + 1) * d]
        codes[:, p] = nearest(own, books[p])
        away = own - books[p][codes[:, p]]
        error += (away * away).sum(1)
    return codes, error


def _round(staged: DataFrame, books: np.ndarray) -> np.ndarray:
    """The floor means of what is assigned to each entry; an entry without vectors stays."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, d), np.int64), np.zeros(parts * entries, np.int64)
        for _, x in blocks(batches, parts * d):
            codes, _ = assign(x, books)
            for p in range(parts):
                at = p * entries + codes[:, p]
                by = np.argsort(at, kind="stable")
                found, first = np.unique(at[by], return_index=True)
                total[found] += np.add.reduceat(x[by, p * d : (p + 1) * d], first, axis=0)
                count += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(count)
        values = np.concatenate([count[used, None], total[used]], axis=1)
        slot = used[:, None] * (d + 1) + np.arange(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(slot.ravel()), pa.array(values.ravel())], names=["slot", "value"])

    sums = np.zeros(parts * entries * (d + 1), np.int64)
    for slot, value in staged.mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.sum("value")).collect():  # a row for each number of the codebooks
        sums[slot] = value
    sums = sums.reshape(parts, entries, d + 1)
    count = sums[:, :, :1]
    return np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)


class VectorCodes:
    """Codebooks made from all vectors, and the codes of those vectors."""

    def __init__(self, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, scale: float = 4096.0, parts: int = 8, entries: int = 16, rounds: int = 6):
        if not 1 <= entries <= 256:
            raise ValueError("1 to 256 entries")
        self.staged = stage(_quantize(vectors, id_col, vector_col, label_col, scale), "vectors")
        longest = (self.staged.agg(F.max(F.length("v"))).first()[0] or 0) // 4
        width = -(-longest // parts)
        if width * parts > WIDEST:
            raise ValueError(f"vectors of more than {WIDEST} components")
        # One row for each entry.
        first = self.staged.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
        start = [np.frombuffer(bytes(r["v"]).ljust(4 * width * parts, b"\0"), "<i4").astype(np.int64) for r in first]
        self.books = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
        if len(start):
            for _ in range(rounds):
                self.books = _round(self.staged, self.books)

    def encode(self) -> DataFrame:
        """``id, label, code`` (two hex digits for each part) and ``error``, the squared distances of all parts."""
        books = self.books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x in blocks(batches, books.shape[0] * books.shape[2]):
                codes, error = assign(x, books)
                text = [row.tobytes().hex() for row in codes.astype("u1")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

        id_, label = self.staged.schema["id"], self.staged.schema["label"]
        return self.staged.mapInArrow(run, T.StructType([id_, label, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))

    def digest(self) -> str:
        """SHA-256 of all entries' components, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the error of all rows of the same label, nulls together. A frequent label's sum is broadcast, so no task of the join holds all its rows."""
    sums = stage(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * LABELS >= total
    same = lambda s: F.col("label").eqNullSafe(F.col(f"{s}._label"))
    named = sums.withColumnRenamed("label", "_label")
    found = codes.join(F.broadcast(named.where(often)).alias("h"), same("h"), "left")
    if sums.where(~often).isEmpty():
        return found.drop("_label", "n")
    rest = found.where("n is null").select(*codes.columns).join(named.where(~often).alias("l"), same("l"))
    return found.where("n is not null").drop("_label", "n").unionByName(rest.drop("_label", "n"))
