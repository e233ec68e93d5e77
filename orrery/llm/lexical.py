"""Ranked lexical search with block-max pruning.

The index is made for the terms of the queries. Documents are taken in ranges of a few
hundred rows, each a block. A block holds a forward index (of each document the terms and
their impacts) and, for each term, its largest impact in the block. A query's bound on a
block is the sum of those maxima, weighted as its terms are. A task takes the blocks of a
query in order of falling bound and scores them until a bound is below the score that a
document must have to be among the best.

That score comes from all tasks: in a first pass each task scores the one block of largest
bound for each query, and the best of these documents set the threshold with which the
second pass starts. A block is left out only when its bound is below it, so ties stay.

Scores are integers: the sum over a query's terms, repeats included, of
``w * ((10^9 tf) div (1000 tf + 8 m))`` with ``w = floor(1000 ln((2N + 2) / (2df + 1)))`` and
``m = 25 + (75 n N) div L``; N documents with a term, L terms in all, n of the document.

Bounds: queries are taken in batches of at most ``batch_bytes`` of text, a pass over the
documents each, so terms and weights that are sent to the workers have a fixed size. A task
holds a group of blocks. From each pass a task gives at most ``k`` rows for each query.

Ids of documents are whole numbers. Defined results: a null or empty text has no terms, and is in no result; so is a document
with none of a query's terms. Of equal scores the lesser id comes first, null last. Rows that
share an id are documents of their own; identical queries are answered once each. Empty tables
give an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import ship, stage

#: Documents of a block, and blocks that a task holds.
BLOCK, GROUP = 256, 128
OUT_ROWS = 2000
# Bytes of terms stay (A-Z in lower case; all of UTF-8 beyond ASCII belongs to terms), others become spaces.
_TERM = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b in _TERM else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def packed(values) -> bytes:
    return np.asarray(values, "<i8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


class Queries:
    """A batch of queries: their terms, numbered, and of each query (term, repeats)."""

    def __init__(self, texts: list[bytes]):
        found = [Counter(terms(t)) for t in texts]
        self.number = {t: i for i, t in enumerate(sorted({t for c in found for t in c}))}
        self.terms = [np.array(sorted(self.number[t] for t in c), np.int64) for c in found]
        self.repeats = [np.array([n for _, n in sorted((self.number[t], n) for t, n in c.items())], np.int64) for c in found]


def _forward(docs: DataFrame, id_col: str, text_col: str, number: dict[bytes, int]) -> DataFrame:
    """``id, n, terms, tf`` of every document that has a term: all its terms counted, those of the queries listed."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(number)  # bounded by the batch of queries
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(lo, OUT_ROWS)
                keep, n, held, times = [], [], [], []
                for i, text in enumerate(batch.column("text").cast(pa.binary())):
                    words = terms(text.as_py())
                    if words:
                        count = Counter(map(known.get, words))
                        count.pop(None, None)
                        at = sorted(count)
                        keep.append(i)
                        n.append(len(words))
                        held.append(packed(at))
                        times.append(packed([count[t] for t in at]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(held, pa.binary()), pa.array(times, pa.binary())], names=["id", "n", "terms", "tf"])

    ship(spark)
    return rows.mapInArrow(run, "id long, n long, terms binary, tf binary")


def _frequencies(forward: DataFrame, size: int) -> np.ndarray:
    """Of each term, the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(unpacked(b"".join(batch.column("terms").to_pylist())), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for term, df in forward.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # a row for each term of the queries
        out[term] = df
    return out


def impacts(n: np.ndarray, tf: np.ndarray, docs: int, length: int) -> np.ndarray:
    m = np.array([25 + 75 * int(v) * docs // length for v in n], np.int64)  # the product may pass 64 bits
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _blocks(forward: DataFrame, docs: int, length: int) -> DataFrame:
    """A row for each block: ``ids, known`` (whether the id is not null), ``ends`` of the documents in ``terms`` and ``impact``; ``max_terms, max_impact``."""
    names = ("ids", "known", "ends", "terms", "impact", "max_terms", "max_impact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                held = [unpacked(t) for t in b.column("terms").to_pylist()]
                term = np.concatenate(held)
                sizes = np.array([len(h) for h in held])
                tf = unpacked(b"".join(b.column("tf").to_pylist()))
                impact = impacts(np.repeat(b.column("n").to_numpy(), sizes), tf, docs, length)
                by = np.lexsort((-impact, term))
                first = np.unique(term[by], return_index=True)[1] if len(term) else np.zeros(0, int)
                ids = b.column("id")
                out.append(tuple(map(packed, (ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), np.cumsum(sizes), term, impact, term[by][first], impact[by][first]))))
                if len(out) == GROUP:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=names)

    return forward.mapInArrow(run, ", ".join(f"{n} binary" for n in names))


class Group:
    """Blocks that a task holds, with their maxima ordered by term."""

    def __init__(self, rows: list[dict]):
        self.rows = [{k: unpacked(v) for k, v in r.items()} for r in rows]
        term = np.concatenate([r["max_terms"] for r in self.rows])
        by = np.argsort(term, kind="stable")
        self.term, self.most = term[by], np.concatenate([r["max_impact"] for r in self.rows])[by]
        self.block = np.repeat(np.arange(len(self.rows)), [len(r["max_terms"]) for r in self.rows])[by]

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.rows), np.int64)
        for a, b, w in zip(np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right"), weights, strict=True):
            out[self.block[a:b]] += w * self.most[a:b]  # a block has one maximum for a term
        return out

    def scores(self, i: int, weight_of: np.ndarray) -> np.ndarray:
        """Of the block's documents; ``weight_of``: of every term, 0 where the query has it not."""
        r = self.rows[i]
        run = np.concatenate([[0], np.cumsum(weight_of[r["terms"]] * r["impact"])])
        return np.diff(run[np.concatenate([[0], r["ends"]])])


def _better(kept: list[tuple], more: list[tuple], k: int) -> list[tuple]:
    """The ``k`` best of (-score, id is null, id)."""
    return sorted(kept + more)[:k]


def _best(blocks: DataFrame, queries: Queries, weights: np.ndarray, k: int, least: np.ndarray, first_only: bool) -> DataFrame:
    """``query, score, id``: of each task and query the best documents. ``least``: by query, a score that the k best reach for certain. ``first_only``: one block for each query and group."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((queries.terms, queries.repeats, weights, least))  # bounded by the batch of queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_terms, repeats, weight, threshold = shared.value
        best: list[list[tuple]] = [[] for _ in all_terms]
        weight_of = np.zeros(len(weight), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                group = Group(batch.slice(lo, GROUP).to_pylist())
                for q, (terms_, times) in enumerate(zip(all_terms, repeats, strict=True)):
                    own = weight[terms_] * times
                    bound = group.bounds(terms_, own)
                    weight_of[terms_] = own
                    for i in np.argsort(-bound, kind="stable")[: 1 if first_only else None]:
                        needed = max(int(threshold[q]), -best[q][-1][0] if len(best[q]) == k else 1)
                        if bound[i] < needed:
                            break
                        score = group.scores(i, weight_of)
                        at = np.flatnonzero(score >= needed)
                        if len(at):
                            r = group.rows[i]
                            best[q] = _better(best[q], list(zip((-score[at]).tolist(), (r["known"][at] == 0).tolist(), r["ids"][at].tolist(), strict=True)), k)
                    weight_of[terms_] = 0
        rows = [(q, -s, None if null else i) for q, b in enumerate(best) for s, null, i in b]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["query", "score", "id"])

    return blocks.mapInArrow(run, "query long, score long, id long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text", batch_bytes: int = 8_000_000) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` documents of highest score above 0 for each row of ``queries``."""
    spark = docs.sparkSession
    asked = queries.select(F.col(f"`{query_id_col}`").alias("query_id"), F.coalesce(F.col(f"`{query_text_col}`").cast("string"), F.lit("")).alias("text"))
    asked = stage(asked.groupBy("query_id", "text").agg(F.count("*").alias("copies")), "asked")
    size = asked.agg(F.sum(F.length(F.encode("text", "utf-8")) + 64)).first()[0] or 0
    n = -(-size * 2 // batch_bytes) if size > batch_bytes else 1
    out = None
    for b in range(n):
        part = asked.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(n)) == b).orderBy("query_id", "text").collect()  # batch_bytes, whatever the number of queries
        if part:
            found = _answer(docs, id_col, text_col, Queries([r["text"].encode() for r in part]), k)
            names = spark.createDataFrame([(i, r["query_id"], r["copies"]) for i, r in enumerate(part)], T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("copies", T.LongType())]))
            rows = stage(found.join(F.broadcast(names), "query").select("query_id", "copies", F.col("rank").cast("int").alias("rank"), "id", "score"), "ranked")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "id", "score")


def _answer(docs: DataFrame, id_col: str, text_col: str, queries: Queries, k: int) -> DataFrame:
    forward = stage(_forward(docs, id_col, text_col, queries.number), "forward")
    n, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(forward, len(queries.number))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in df], np.int64)
    blocks = stage(_blocks(forward, n, max(length, 1)), "blocks")
    least = np.ones(len(queries.terms), np.int64)
    seen = _top(_best(blocks, queries, weights, k, least, True), k)
    for q, score in seen.where(F.col("rank") == k).select("query", "score").collect():  # a row for each query of the batch
        least[q] = score
    return _top(_best(blocks, queries, weights, k, least, False), k)
