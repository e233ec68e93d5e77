"""N-gram Jaccard join by T-occurrence search.

A document is the set of its distinct shingles, as sorted 64-bit hashes. Equal sets are one
class, told by 64 bits of a digest as shingles are; only classes are compared. Two classes of similarity t or more
share so many shingles that their prefixes (the first ``n - ceil(t n) + slack(n)`` hashes)
have at least ``slack`` of them in common. That routes them:

* A prefix shingle held by few classes (at most ``light``) gives pairs, which are counted. A
  pair goes on if the count, with the heavy shingles either may hide, reaches the slack.
* Heavy shingles give no pairs. Only classes with as many of them in the prefix as the slack
  ("dense") can hide from the count, and only from each other; these are tied together, each
  to the least dense class with the shingle.

The ties' components are sets of classes outside of which nothing can be similar. Their whole
sets are brought together, in units of bounded size (a large component is cut into blocks),
and searched: for a class of n shingles and least overlap T
the T - slack longest inverted lists are put aside, the short ones are merged by a heap, and
classes that occur ``slack`` times are probed for by binary search in the rest (DivideSkip).
For components a class need not be searched for when it and all others not searched for are
in one component already, so that large groups of near copies cost one search each, not all
pairs; of a component in blocks only what such searches leave apart meets the other blocks.
``ShingleJoin.pairs`` searches for every class, in each pair of blocks, and gives all links.

Nothing is capped or sampled; shingles with a great many holders are combined in each batch
before they are shuffled, so no task gets more than a few of their rows from each batch.

Defined results: null, empty and blank texts have no shingles, link with nothing and are
their own component; a text of fewer words than a shingle is one shingle; a null id is the
least id; rows that share an id and a text fall together as copies, of rows that share an id
but not a text each has the component of its text, told apart by ``component_key``; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import Union, components
from .store import partitions, ship, stage

NO_ID = -(2**63)
#: A table of so many bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16_000_000
UNIT_SHINGLES = 4_000_000
#: So many postings are merged by a heap; more are counted in an array, which is faster by far.
HEAP_POSTINGS = 4_000
MAX_WORDS = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


@cache
def word_hashes() -> WordHashes:
    return WordHashes()


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles, sorted. Lower-casing and splitting bytes touch ASCII only."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = len(ws) - k + 1
    if n < 1:
        h, out = h.reshape(-1, 1), np.array([len(ws)], np.uint64)
        cols = h
    else:
        out = np.zeros(n, np.uint64)
        cols = [h[i : i + n] for i in range(k)]
    for c in cols:
        out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    if len(hashes) > MAX_WORDS:
        hashes.clear()
    return np.unique(out)


def slack(n):
    return 1 + n // 10


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + slack(n))


def _sets(docs: DataFrame, k: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    """``id, text_hash, n, d1, prefix`` of each row: d1 is a digest of the set."""
    schema = "id long, text_hash long, n long, d1 long, prefix binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for b in batches:
            n, d1, pre = [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), k, hashes)
                n.append(len(s))
                d1.append(int.from_bytes(xxhash.xxh128_digest(s.tobytes())[:8], "big", signed=True))
                pre.append(s[: prefix_length(len(s), percent)].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(pre, pa.binary())], names=["id", "text_hash", "n", "d1", "prefix"])

    ship(docs.sparkSession)
    return _named(docs, text_col, id_col).mapInArrow(run, schema)


def _named(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _lists(batches: Iterator[pa.RecordBatch], names: list[str]):
    """Batches of a prefix column as flat arrays: shingle and row."""
    for b in batches:
        pre = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(names.index("prefix"))]
        rows = np.repeat(np.arange(len(pre)), [len(p) for p in pre])
        yield b, (np.concatenate(pre) if pre else np.empty(0, np.uint64)), rows


POSTING = np.dtype([("shingle", "<u8"), ("cid", "<i8"), ("n", "<i4")])
MARK = -1  # of n: a shingle that one batch has found to be heavy


def _postings(sets: DataFrame, light: int, buckets: int) -> DataFrame:
    """Rows for ``_meet`` by bucket: packed postings; or ``cid`` and how many of its shingles this batch has found heavy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Copies within the batch are one class already.
            _, once = np.unique(b.column(0).to_numpy(), return_index=True)
            b = b.take(pa.array(once))
            for b, s, rows in _lists(iter([b]), b.schema.names):
                cid, n = b.column(0).to_numpy(), b.column(1).to_numpy()
                _, at, count = np.unique(s, return_inverse=True, return_counts=True)
                often = count[at] > light
                heavy = np.bincount(rows[often], minlength=len(cid))
                out = [(int(c) % buckets, int(c), int(h), None) for c, h in zip(cid[heavy > 0], heavy[heavy > 0], strict=True)]
                marks = np.unique(s[often])
                p = np.empty(len(s) - int(often.sum()) + len(marks), POSTING)
                own = ~often
                m = int(own.sum())
                p["shingle"][:m], p["cid"][:m], p["n"][:m] = s[own], cid[rows[own]], n[rows[own]]
                p["shingle"][m:], p["cid"][m:], p["n"][m:] = marks, 0, MARK
                to = (p["shingle"] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                p, to = p[order], to[order]
                cuts = np.flatnonzero(np.diff(to, prepend=-1)) if len(to) else []
                for i, lo in enumerate(cuts):
                    hi = cuts[i + 1] if i + 1 < len(cuts) else len(p)
                    out.append((int(to[lo]), 0, 0, p[lo:hi].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "cid", "heavy", "data"])

    return sets.select(F.col("d1").alias("cid"), "n", "prefix").mapInArrow(run, "bucket long, cid long, heavy long, data binary")


def _meet(packed: DataFrame, light: int, percent: int) -> DataFrame:
    """``a, b, n``: pairs at a light shingle (a < b); ``b`` null: a class and how many of its shingles are heavy; ``a`` null: b is a heavy shingle."""

    def run(table: pa.Table) -> pa.Table:
        data = [x for x in table.column("data").to_pylist() if x is not None]
        p = np.concatenate([np.frombuffer(x, POSTING) for x in data]) if data else np.empty(0, POSTING)
        p = p[np.lexsort((p["cid"], p["shingle"]))]
        if len(p):  # copies of a class in other batches
            p = p[np.append(True, (p["shingle"][1:] != p["shingle"][:-1]) | (p["cid"][1:] != p["cid"][:-1]) | (p["n"][1:] != p["n"][:-1]))]
        first = np.flatnonzero(np.append(True, p["shingle"][1:] != p["shingle"][:-1])) if len(p) else np.empty(0, np.int64)
        count = np.diff(first, append=len(p))
        marked = np.logical_or.reduceat(p["n"] == MARK, first) if len(p) else np.empty(0, bool)
        heavy = marked | (count > light)
        each = np.repeat(heavy, count)
        own = p["cid"][each & (p["n"] != MARK)]
        cids, n_heavy = np.unique(own, return_counts=True)
        told = np.flatnonzero(table.column("heavy").to_numpy())
        cids = np.concatenate([cids, table.column("cid").to_numpy()[told]])
        n_heavy = np.concatenate([n_heavy, table.column("heavy").to_numpy()[told]])
        tokens = p["shingle"][first[heavy]].astype(np.int64)
        q = p[~each]
        a, b = [], []
        # Pairs of places d apart in the same list: each pair once.
        for d in range(1, light):
            same = q["shingle"][d:] == q["shingle"][:-d]
            if not same.any():
                break
            x, y = q["n"][:-d].astype(np.int64), q["n"][d:].astype(np.int64)
            same &= 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
            a.append(q["cid"][:-d][same])
            b.append(q["cid"][d:][same])
        pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1) if a else np.empty((0, 2), np.int64)
        pairs, n_pairs = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.empty(0, np.int64))
        left = pa.concat_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(cids, pa.int64()), pa.nulls(len(tokens), pa.int64())])
        right = pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(cids), pa.int64()), pa.array(tokens, pa.int64())])
        return pa.table({"a": left, "b": right, "n": pa.array(np.concatenate([n_pairs, n_heavy, np.zeros(len(tokens), np.int64)]).astype(np.int64))})

    return packed.groupBy("bucket").applyInArrow(run, "a long, b long, n long")


def _dense_ties(dense: DataFrame, heavy: DataFrame) -> DataFrame:
    """``a, b``: each dense class and the least dense class with the same heavy shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, s, rows in _lists(batches, ["cid", "prefix"]):
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64), pa.int64()), pa.array(b.column(0).to_numpy()[rows], pa.int64())], names=["shingle", "cid"])

    held = dense.select("cid", "prefix").mapInArrow(run, "shingle long, cid long").distinct().join(heavy, "shingle", "left_semi")
    least = held.groupBy("shingle").agg(F.min("cid").alias("a"))
    return held.join(least, "shingle").where("a <> cid").select("a", F.col("cid").alias("b")).distinct()


def merged(lists: list[np.ndarray], n: int, occur: int) -> list[tuple[int, int]]:
    """The members that are in ``occur`` lists or more, and in how many: by a heap, or, of many postings, by counting them all at once."""
    if sum(map(len, lists)) <= HEAP_POSTINGS:
        counts = ((y, sum(1 for _ in found)) for y, found in groupby(heapq.merge(*[x.tolist() for x in lists])))
        return [(y, c) for y, c in counts if c >= occur]
    counts = np.bincount(np.concatenate(lists), minlength=n)
    often = np.flatnonzero(counts >= occur)
    return list(zip(often.tolist(), counts[often].tolist(), strict=True))


def search(sets: list[np.ndarray], percent: int, every: bool = False, asked_for: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Ties (a, b) of positions that join all sets of enough similarity, and no others, into components; with ``every``, all similar pairs (a < b); with ``asked_for``, links of these positions only."""
    n = [len(s) for s in sets]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.diff(flat, prepend=~flat[:1]))
    ends = np.append(starts[1:], len(flat))
    names = flat[starts]
    union, ties = Union(len(sets)), []

    def query(x: int) -> None:
        own = sets[x]
        at = np.searchsorted(names, own)
        lo, hi = starts[at], ends[at]
        by_length = np.argsort(hi - lo, kind="stable")
        least = least_overlap(n[x], percent)
        occur = min(least, slack(n[x]))
        short, rest = by_length[: n[x] - least + occur], own[by_length[n[x] - least + occur :]]
        lists = [owner[lo[i] : hi[i]] for i in short if hi[i] - lo[i] > 1]
        for y, c in merged(lists, len(sets), occur):
            if (y <= x if every else y == x or union.find(x) == union.find(y)) or 100 * min(n[x], n[y]) < percent * max(n[x], n[y]):
                continue
            other = sets[y]
            place = np.minimum(np.searchsorted(other, rest), n[y] - 1)
            c += int((other[place] == rest).sum())
            if 100 * c >= percent * (n[x] + n[y] - c) and (every or union.join(x, y)):
                ties.append((x, y))

    if every or asked_for is not None:
        for x in range(len(sets)) if every else asked_for.tolist():
            query(x)
        return ties
    asked = set()
    for x in {0, len(sets) // 2, len(sets) - 1}:
        query(x)
        asked.add(x)
    # All classes but those of one component are searched for: a pair that is left lies within it.
    roots = [union.find(x) for x in range(len(sets))]
    main = max(set(roots), key=roots.count) if len(sets) > 2 else -1
    for x in range(len(sets)):
        if roots[x] != main and x not in asked:
            query(x)
    return ties


def _search_units(units: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Ties in units of ``unit, comp, key, ask, data``. Where a component has classes that are asked for, only their links are looked for."""

    def run(table: pa.Table) -> pa.Table:
        comp, key, ask = (table.column(c).to_numpy() for c in ("comp", "key", "ask"))
        data = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("data")]
        by = np.lexsort((~ask, key))
        once = by[np.append(True, np.diff(key[by]) != 0)]  # the text of a class may be there twice
        order = once[np.argsort(comp[once], kind="stable")]
        a, b = [], []
        for _, part in groupby(order, key=lambda i: comp[i]):
            part = np.array(list(part))
            if len(part) > 1:
                some = np.flatnonzero(ask[part])
                for x, y in search([data[i] for i in part], percent, every, some if len(some) and not every else None):
                    a.append(key[part[x]])
                    b.append(key[part[y]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return units.groupBy("unit").applyInArrow(run, "a long, b long")


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _blocks(total) -> Column:
    total = F.col(total) if isinstance(total, str) else total
    return F.when(total > UNIT_SHINGLES, F.ceil(2 * total / UNIT_SHINGLES)).otherwise(1).cast("long")


class ShingleJoin:
    """The join of ``docs`` with themselves; links are similarities of at least ``percent``."""

    def __init__(self, docs: DataFrame, *, k: int = 5, percent: int = 80, light: int = 12, text_col: str = "text", id_col: str = "doc_id"):
        self.percent = percent
        self.sets = sets = stage(_sets(docs, k, percent, text_col, id_col), "sets")
        first = F.min(F.struct("id", "text_hash"))
        self.classes = classes = stage(sets.where("n > 0").groupBy("d1").agg(F.min("n").alias("n"), first.alias("first")), "classes")
        met = stage(_meet(_postings(sets.where("n > 0"), light, 4 * partitions(docs.sparkSession)), light, percent), "met")
        near = components(self._candidates(met))

        # Components are packed into bins of bounded size; one that is larger is cut into blocks.
        near = stage(near.withColumnRenamed("id", "key").join(classes, F.col("key") == F.col("d1")).select("key", "root", "n", "first"), "near_classes")
        sums = near.groupBy("root").agg(F.sum("n").alias("total"), F.min("key").alias("low"), F.max("key").alias("high"))
        bins = max(1, -(-int(sums.agg(F.sum("total")).first()[0] or 0) // UNIT_SHINGLES)) * 4
        placed = near.join(sums.select("root", "low", "high", _blocks("total").alias("blocks")), "root")
        own = F.pmod(F.xxhash64("key"), F.col("blocks"))
        hub = (F.col("blocks") > 1) & ((F.col("key") == F.col("low")) | (F.col("key") == F.col("high")))
        placed = stage(placed.select("key", "root", "n", "first.id", "first.text_hash", "blocks", own.alias("own"), F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin"), hub.alias("hub")), "placed")
        texts = _named(docs, text_col, id_col).join(_small(placed, 120), ["id", "text_hash"])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = word_hashes()
            for b in batches:
                data = pa.array([shingles(t.as_py(), k, hashes).tobytes() for t in b.column(7)], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:7], data], names=["key", "comp", "n", "blocks", "own", "bin", "hub", "data"])

        whole_sets = texts.select("key", F.col("root").alias("comp"), "n", "blocks", "own", "bin", "hub", "text").mapInArrow(whole, "key long, comp long, n long, blocks long, own long, bin long, hub boolean, data binary")
        self.whole = stage(whole_sets.where(F.length("data") > 0), "whole_sets")

    def _ties(self) -> DataFrame:
        """Links that hold the components together. A large component's blocks are searched by themselves, each with the same few classes (hubs); what the links found so far leave apart from most of the component then meets all of its blocks."""
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        name = lambda *of: F.concat_ws("_", *of)
        unit = F.when(F.col("blocks") == 1, F.array(name(F.lit("bin"), "bin"))).when(F.col("hub"), F.transform(every, lambda i: name("comp", i))).otherwise(F.array(name("comp", "own")))
        found = stage(_search_units(self.whole.select("key", "comp", F.lit(False).alias("ask"), "data", F.explode(unit).alias("unit")), self.percent), "ties")
        large = stage(self.whole.where("blocks > 1").select("key", "comp", "n").dropDuplicates(["key"]), "large")
        if large.isEmpty():
            return found
        roots = large.join(components(found).withColumnRenamed("id", "key"), "key", "left").select("key", "comp", "n", F.coalesce("root", "key").alias("root"))
        main = roots.groupBy("comp", "root").agg(F.count("*").alias("held")).groupBy("comp").agg(F.max(F.struct("held", "root"))["root"].alias("main"))
        rest = roots.join(main, "comp").where("root <> main").select("key", "comp", "n")
        groups = rest.groupBy("comp").agg(_blocks(F.sum("n")).alias("groups"))
        rest = stage(rest.join(groups, "comp").select("key", F.pmod(F.xxhash64("key"), F.col("groups")).alias("group")), "rest")
        if rest.isEmpty():
            return found
        groups = groups.select("comp", "groups")
        asking = self.whole.join(rest, "key").select("key", "comp", F.lit(True).alias("ask"), "data", F.explode(F.transform(every, lambda i: name("comp", i, "group"))).alias("unit"))
        asked = self.whole.where("blocks > 1").join(groups, "comp").select("key", "comp", F.lit(False).alias("ask"), "data", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda g: name("comp", "own", g))).alias("unit"))
        return found.unionByName(_search_units(asking.unionByName(asked), self.percent))

    def _candidates(self, met: DataFrame) -> DataFrame:
        """Pairs of classes that may be similar: ``a, b``."""
        size = self.classes.select("d1", "n")
        heavy = met.where("a is not null and b is null").groupBy(F.col("a").alias("d1")).agg(F.sum("n").alias("heavy"))
        heavy = stage(heavy.join(size, "d1"), "heavy")
        floor = 1 + F.floor(F.ceil(F.col("n") * self.percent / 100) / 10)
        dense = heavy.where(F.col("heavy") >= floor).select("d1")
        # What a pair must have in common at light shingles.
        pairs = met.where("a is not null and b is not null").groupBy("a", "b").agg(F.sum("n").alias("c"))
        info = size.join(heavy.select("d1", "heavy"), "d1", "left").select("d1", (1 + F.floor(F.col("n") / 10)).alias("slack"), F.coalesce("heavy", F.lit(0)).alias("heavy"))
        one, two = (info.select(F.col("d1").alias(x), F.col("slack").alias(f"s{x}"), F.col("heavy").alias(f"h{x}")) for x in "ab")
        pairs = pairs.join(one, "a").join(two, "b").where(F.col("c") >= F.least("sa", "sb") - F.least("ha", "hb")).select("a", "b")
        tied = _dense_ties(self.sets.join(_small(dense, 32), "d1", "left_semi").select(F.col("d1").alias("cid"), "prefix"), met.where("a is null").select(F.col("b").alias("shingle")))
        return pairs.unionByName(tied)

    def documents(self) -> DataFrame:
        """``id, text_hash, n_shingles, class_id, component_id, class_key, component_key`` for each row; ids of classes and components are the least in them."""
        found = components(self._ties())
        named = self.classes.select("d1", F.col("first.id").alias("cid")).join(found.select(F.col("id").alias("d1"), "root"), "d1", "left").select("d1", "cid", F.coalesce("root", "d1").alias("root"))
        least = named.where("root <> d1").select("root").distinct()
        least = named.join(least, "root", "left_semi").groupBy("root").agg(F.min("cid").alias("least"))
        named = named.join(least, "root", "left").select("d1", "cid", "root", F.coalesce("least", "cid").alias("least"))
        out = self.sets.select("id", "text_hash", "n", "d1").join(named, "d1", "left")
        back = lambda c: F.when(c != NO_ID, c)
        blank = F.col("n") == 0
        of = lambda c: F.when(blank, F.col("id")).otherwise(F.col(c))
        return out.select(
            back(F.col("id")).alias("id"), "text_hash", F.col("n").alias("n_shingles"), back(of("cid")).alias("class_id"), back(of("least")).alias("component_id"),
            F.when(~blank, F.col("d1")).alias("class_key"), F.when(~blank, F.col("root")).alias("component_key"),
        )

    def pairs(self) -> DataFrame:
        """``a, b``: every link between two classes, by ``class_key`` (a < b)."""
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        pair = F.transform(every, lambda i: F.concat_ws("_", "comp", F.least(i, "own"), F.greatest(i, "own")))
        unit = F.when(F.col("blocks") == 1, F.array(F.concat_ws("_", F.lit("bin"), "bin"))).otherwise(pair)
        found = _search_units(self.whole.select("key", "comp", F.lit(False).alias("ask"), "data", F.explode(unit).alias("unit")), self.percent, True)
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def linked_documents(self) -> DataFrame:
        """``documents`` with ``n_links``: the other rows each row is linked with, copies in its own class included."""
        rows = stage(self.documents(), "documents")
        copies = rows.where("n_shingles > 0").groupBy("class_key").agg(F.count("*").alias("copies"))
        both = stage(self.pairs(), "pairs")
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(copies.select(F.col("class_key").alias("b"), "copies"), "b").groupBy(F.col("a").alias("class_key")).agg(F.sum("copies").alias("others"))
        own = copies.join(others, "class_key", "left").select("class_key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        return rows.join(own, "class_key", "left").select(*[c for c in rows.columns], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``ShingleJoin.documents`` of ``docs``."""
    return ShingleJoin(docs, **how).documents()
