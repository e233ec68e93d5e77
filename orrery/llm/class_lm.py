"""Brown class-based n-gram scores.

Words are lower-cased (A-Z) runs of characters that are not white space; each text ends
with one end token. Every word of the training texts gets a class from its own neighbours:

* The ``clustered`` most frequent words, and ``endings`` symbols for all others by their last
  letters, are exchanged between classes until no move raises the likelihood of the class
  bigrams (or for ``passes`` passes, if given). That makes the classes.
* All others then leave their ending for the class in which their own counts of classes
  before and after raise the likelihood most: first the ``known`` most frequent, which
  workers hold, then the rest, whose counts are joined by shuffle. This is one round: words
  of a tier are moved at once, each against the classes as they stood before.
* The class of an ending is for words that training has not seen.

The model is P(class | class before) P(word | class), both smoothed, with class bigrams of all
tokens; a score is its log10 over a text.

Texts are read twice to learn: once to count words, once to put codes in place of them. The
steps that follow read the codes, and of words that workers do not hold the letters.

Bounded by parameters, whatever the corpus: the classes, the symbols that make them, and the
table of words that workers hold. Classes and log counts of all other words come from a
shuffled table, so every word has its own and every count is exact.

Defined results: a null text is empty and has its end token only; a null id is an empty
string to the fold; rows are scored alone, so ids may be repeated; with no training texts
every count is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, ship, stage

FLUSH = 1_000_000
#: Held words whose neighbour counts are one row.
BLOCK = 128
#: Rows that are scored together: what workers hold of their words is bounded by it.
ROWS = 1000


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    """The tokens of each text; the column's bytes are UTF-8, and only ASCII is lower-cased or split at."""
    for t in column.cast(pa.binary()):
        yield tokens(t.as_py())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()
        return got

    for b in batches:
        for ws in _texts(b.column(0)):
            counts.update(ws)
            if len(counts) > FLUSH:
                yield out()
    yield out()


class Symbols(dict):
    """Codes of words: the place among those held, or behind them the ending."""

    def __init__(self, held: list[bytes], endings: int):
        super().__init__((w, i) for i, w in enumerate(held))
        self.first, self.endings, self.most = len(held), endings, len(held) + 30_000  # few of the others are met again, and idle workers keep them
        self.own = dict(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
            self.update(self.own)
        got = self[word] = self.first + zlib.crc32(word[-3:]) % self.endings
        return got

    def runs(self, column: pa.Array, most: int = 100_000) -> Iterator[Run]:
        """Texts in runs of some ``most`` words, each of which is one array of codes."""
        texts, held = [], 0
        for ws in _texts(column):
            texts.append(ws)
            held += len(ws) + 1
            if held >= most:
                yield Run(self, texts)
                texts, held = [], 0
        if texts:
            yield Run(self, texts)


class Run:
    """Texts one after the other: ``codes`` with an end before, between and after them; ``ends``: where these are; ``words``, and the place of each code's word among them (-1: an end)."""

    def __init__(self, symbols: Symbols, texts: list[list[bytes]]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.words = [w for ws in texts for w in ws]
        self.ends = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.codes = np.full(self.ends[-1] + 1, symbols.first + symbols.endings, np.int64)
        self.place = np.full(len(self.codes), -1, np.int64)
        at = np.arange(len(self.words)) + 1 + np.repeat(np.arange(len(texts)), sizes)
        self.codes[at] = np.fromiter(map(symbols.__getitem__, self.words), np.int64, len(self.words))
        self.place[at] = np.arange(len(self.words))

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums by text of a value for each pair of neighbours."""
        return np.add.reduceat(values, self.ends[:-1])


def _blobs(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose values are the stretches of ``data`` up to each end."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i4").tobytes()), pa.py_buffer(data)])


def _bytes(column: pa.BinaryArray) -> tuple[np.ndarray, pa.Buffer | bytes]:
    """The offsets of a binary column's values and the bytes they are in."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    return np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64), data or b""


def coded(run: Run, held: int) -> list[pa.Array]:
    """Of each text of a run the codes with its end, and its words that are not held, each with a blank behind it."""
    other = np.flatnonzero((run.codes >= held) & (run.place >= 0))
    words = [run.words[i] for i in run.place[other].tolist()]
    sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    return [_blobs(run.codes[1:].astype("<i4").tobytes(), 4 * run.ends[1:]), _blobs(b"".join([w + b" " for w in words]), sizes[np.searchsorted(other, run.ends[1:])])]


def decoded(codes: pa.BinaryArray, others: pa.BinaryArray | None = None, most: int = 100_000) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Texts in runs of some ``most`` codes, with an end before, between and after them, and their words that are not held."""
    if not len(codes):
        return
    at, data = _bytes(codes)
    of_words, letters = _bytes(others) if others is not None else (None, b"")
    flat = np.frombuffer(data, "<i4", at[-1] // 4)
    lo = 0
    while lo < len(codes):
        hi = min(int(np.searchsorted(at, at[lo] + 4 * most, "left")), len(codes))
        part = flat[at[lo] // 4 : at[hi] // 4]
        words = memoryview(letters)[of_words[lo] : of_words[hi]].tobytes().split() if others is not None else []
        yield np.concatenate([part[-1:], part]).astype(np.int64), words
        lo = hi


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, passes: int | None = None) -> np.ndarray:
    """The class of each symbol: pairs[i, j] counts symbol j after i; the last symbol is the text end and has a class of its own, the last. Without ``passes``, until no move is a gain."""
    n = len(pairs)
    pairs = pairs.astype(np.float64)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight[: n - 1], kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n - 1) % classes
    of[n - 1] = classes
    every = classes + 1
    member = np.zeros((n, every))
    member[np.arange(n), of] = 1
    out, into = pairs @ member, (member.T @ pairs).T  # of a symbol: counts by class after and before it
    table = member.T @ out
    right, left = pairs.sum(1), pairs.sum(0)
    at = np.arange(every)
    for _ in count() if passes is None else range(passes):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a, self_ = of[w], pairs[w, w]
            o, i = out[w].copy(), into[w].copy()
            o[a] -= self_
            i[a] -= self_
            table[a] -= o
            table[:, a] -= i
            table[a, a] -= self_
            rows, cols = table.sum(1) + i, table.sum(0) + o  # with what passes between this symbol and the classes, wherever it goes
            gain = (_phi(table + o) - _phi(table)).sum(1) + (_phi(table + i[:, None]) - _phi(table)).sum(0)
            d = table[at, at]
            gain += _phi(d + o + i + self_) - _phi(d + o) - _phi(d + i) + _phi(d)
            gain -= _phi(rows + right[w]) - _phi(rows) + _phi(cols + left[w]) - _phi(cols)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-12 * (1 + np.abs(_phi(table)).sum()):
                b = int(a)  # a gain that rounding can make is none, so the loop ends
            table[b] += o
            table[:, b] += i
            table[b, b] += self_
            if b != a:
                of[w] = b
                out[:, a] -= pairs[:, w]
                out[:, b] += pairs[:, w]
                into[:, a] -= pairs[w]
                into[:, b] += pairs[w]
                moved += 1
        if not moved:
            break
    return of


def choose(out: np.ndarray, into: np.ndarray, now: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class of each word by its counts of classes after and before it; ``table`` has them under the class of ``now``. The last class is the text end's."""
    gain = np.zeros(out.shape)
    each = np.arange(len(out))
    for counts, t in ((out, table), (into, table.T)):
        w, c = np.nonzero(counts)
        if not len(w):
            continue
        k, cells = counts[w, c].astype(np.float64), t[:, c].T
        change = _phi(cells + k[:, None]) - _phi(cells)
        at = np.arange(len(w)), now[w]
        change[at] = _phi(cells[at]) - _phi(cells[at] - k)  # where it is, it is counted already
        first = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[first]] += np.add.reduceat(change, first)
        total, sums = counts.sum(1).astype(np.float64), t.sum(1)
        change = _phi(sums + total[:, None]) - _phi(sums)
        change[each, now] = _phi(sums[now]) - _phi(sums[now] - total)
        gain -= change
    best = np.argmax(gain[:, :-1], axis=1)
    return np.where(gain[each, best] > gain[each, now] + 1e-9, best, now)


class ClassLM:
    """Learns from ``training`` (a text column) and scores any texts."""

    def __init__(self, training: DataFrame, *, clustered: int = 1000, endings: int = 128, classes: int = 64, passes: int | None = None, known: int = 100_000, prior: float = 20.0):
        self.spark = training.sparkSession
        ship(self.spark)
        texts = training.select(F.col(training.columns[0]).alias("text"))
        self.vocabulary = stage(texts.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
        types, words = self.vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        top = self._frequent(known)
        held, own, every = len(top), min(len(top), clustered), classes + 1
        symbols = Symbols([w for w, _ in top], endings)
        shared = self.spark.sparkContext.broadcast(symbols)
        # Of each code: the symbol that makes the classes.
        core = np.array([*range(own), *(own + zlib.crc32(w[-3:]) % endings for w, _ in top[own:]), *range(own, own + endings + 1)], np.int64)
        codes, pairs = self._coded(texts, shared, core, held, own + endings + 1)
        of = exchange(pairs, classes, passes)[core]
        ends = int(pairs[:, -1].sum())
        self.n, self.v = int(words) + ends, int(types) + (ends > 0)
        if held > own:
            member = np.zeros((len(pairs), every))
            member[core, of] = 1
            of = self._place_held(codes, of, own, held, member.T @ pairs @ member)
        table, n_types = self._place_others(codes, endings, of, held, every)
        n_types += np.bincount(of[:held], minlength=every)
        uses = table.sum(0)
        alone = (uses + 1) / (uses.sum() + every)
        step = np.log10((table + prior * alone) / (table.sum(1, keepdims=True) + prior))
        under = np.log10(n_types + uses + 1)  # what log10(c + 1) of a word of the class is taken from
        under[-1] = 0.0
        self.classes = {w: int(c) for (w, _), c in zip(top, of, strict=False)}  # of the held words; the others' are in self.others
        self._worker = (symbols, of, step, under, np.array([c for _, c in top], np.int64), ends)

    @staticmethod
    def _coded(texts: DataFrame, shared: Broadcast, core: np.ndarray, held: int, size: int) -> tuple[DataFrame, np.ndarray]:
        """``codes, others`` (``coded``) for each text; and the counts of pairs of symbols, which the same pass makes."""
        names = ["codes", "others", "before", "counts"]

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sym, total = shared.value, np.zeros(size * size, np.int64)
            for b in batches:
                for run in sym.runs(b.column(0)):
                    s = core[run.codes]
                    total += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
                    found = coded(run, held)
                    yield pa.RecordBatch.from_arrays([*found, pa.nulls(len(found[0]), pa.int64()), pa.nulls(len(found[0]), pa.binary())], names=names)
            pa.default_memory_pool().release_unused()
            rows = total.reshape(size, size)
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int64()), pa.array([zlib.compress(rows[i].tobytes(), 1) for i in some], pa.binary())], names=names)

        def summed(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table.column("counts"))
            return pa.table({"before": pa.array([table.column("before")[0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

        schema = "before long, counts binary"
        made = stage(texts.mapInArrow(put, f"codes binary, others binary, {schema}"), "codes")
        pairs = np.zeros((size, size), np.int64)
        for r in made.where("before is not null").select("before", "counts").groupBy("before").applyInArrow(summed, schema).collect():  # bounded: one row a symbol
            pairs[r["before"]] = np.frombuffer(r["counts"], np.int64)
        return made, pairs

    @staticmethod
    def _place_held(codes: DataFrame, of: np.ndarray, own: int, held: int, table: np.ndarray) -> np.ndarray:
        """The classes of codes, with those of the held words after the first ``own`` chosen anew."""
        every = len(table)
        width = 2 * every  # classes after, classes before

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, one = np.zeros((held - own) * width, np.int32), np.int32(1)
            for b in batches:
                for s, _ in decoded(b.column(0)):
                    p = np.flatnonzero((s >= own) & (s < held))
                    at, c = (s[p] - own) * width, of[s]
                    np.add.at(total, at + c[p + 1], one)
                    np.add.at(total, at + every + c[p - 1], one)
            for i in range(0, held - own, BLOCK):
                part = total[i * width : (i + BLOCK) * width]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["first", "counts"])

        def chosen(t: pa.Table) -> pa.Table:
            first = t.column("first")[0].as_py()
            n = min(BLOCK, held - own - first)
            total = np.zeros(n * width, np.int64)
            for x in t.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.int32)
            total = total.reshape(n, 2, every)
            got = choose(total[:, 0], total[:, 1], of[own + first : own + first + n], table)
            return pa.table({"code": pa.array(np.arange(n) + own + first, pa.int64()), "class": pa.array(got, pa.int64())})

        found = codes.where("codes is not null").select("codes").mapInArrow(near, "first long, counts binary").groupBy("first").applyInArrow(chosen, "code long, class long").toArrow()  # bounded: the held words
        out = of.copy()
        out[found.column("code").to_numpy()] = found.column("class").to_numpy()
        return out

    def _place_others(self, codes: DataFrame, endings: int, of: np.ndarray, held: int, every: int) -> tuple[np.ndarray, np.ndarray]:
        """Makes ``others`` (word, c, class: the words that are not held); the class bigrams of all tokens, and how many of these words each class has."""
        cells, wide = every * every, 2 * every  # a neighbour that is not held has every + the class of its ending

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * cells, np.int64)
            end = len(of) - 1
            words, nexts, keys = [], [], []

            def out() -> pa.RecordBatch:
                key = np.concatenate([np.empty(0, np.int64), *keys])
                got = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(nexts, pa.binary()), pa.array(key), pa.array(np.ones(len(key), np.int64))], names=["word", "next", "key", "n"])
                words.clear()
                nexts.clear()
                keys.clear()
                return got

            for b in batches:
                for s, ws in decoded(b.column(0), b.column(1)):
                    c, other = of[s], (s >= held) & (s < end)
                    bigram = c[:-1] * every + c[1:]
                    total[:cells] += np.bincount(bigram, minlength=cells)
                    total[cells:] += np.bincount(bigram[~(other[:-1] | other[1:])], minlength=cells)
                    p = np.flatnonzero(other)
                    if len(p):
                        c = c + every * other
                        words += ws
                        nexts += [w if both else None for w, both in zip([*ws[1:], None], other[p + 1].tolist(), strict=True)]
                        keys.append(c[p - 1] * wide + c[p + 1])
                    if len(words) > FLUSH // 4:
                        yield out()
            some = np.flatnonzero(total)
            yield out()
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["word", "next", "key", "n"])

        raw = stage(codes.where("codes is not null").select("codes", "others").mapInArrow(near, "word binary, next binary, key long, n long"), "near")
        drop(self.spark, "codes")
        total = np.zeros(2 * cells)
        for r in raw.where("word is null").groupBy("key").agg(F.sum("n").alias("n")).collect():  # bounded: pairs of classes
            total[r["key"]] = r["n"]
        before, table = total.reshape(2, every, every)

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for lo in range(0, big.num_rows, 2048):
                    b = big.slice(lo, 2048)
                    ws, lists = b.column(0).to_pylist(), b.column(1)
                    w = np.repeat(np.arange(len(ws)), lists.value_lengths().to_numpy(zero_copy_only=False))
                    flat = lists.flatten()
                    key, n = flat.field("key").to_numpy(), flat.field("n").to_numpy()
                    left, right = key // wide, key % wide
                    out, into = np.zeros((len(ws), every), np.int64), np.zeros((len(ws), every), np.int64)
                    np.add.at(out, (w, right % every), n)
                    np.add.at(into, (w, left % every), n)
                    now = of[held + np.fromiter((zlib.crc32(x[-3:]) % endings for x in ws), np.int64, len(ws))]
                    got = choose(out, into, now, before)
                    # What the words have beside held ones: cells of the table.
                    add = np.zeros((every, every), np.int64)
                    np.add.at(add, (got[w][right < every], right[right < every]), n[right < every])
                    np.add.at(add, (left[left < every], got[w][left < every]), n[left < every])
                    i = np.flatnonzero(add)
                    yield pa.RecordBatch.from_arrays([
                        pa.concat_arrays([b.column(0), pa.nulls(len(i), pa.binary())]), pa.array(np.append(out.sum(1), add.ravel()[i]), pa.int64()), pa.array(np.append(got, i), pa.int64()),
                    ], names=["word", "c", "class"])

        lists = raw.where("word is not null").repartition("word").groupBy("word", "key").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("key", "n")).alias("near"))
        placed = stage(lists.mapInArrow(chosen, "word binary, c long, class long"), "placed")
        for r in placed.where("word is null").groupBy("class").agg(F.sum("c").alias("n")).collect():
            table[divmod(r["class"], every)] += r["n"]
        self.others = placed.where("word is not null")
        one, two = (self.others.select(F.col("word").alias(x), F.col("class").alias(f"of_{x}")).hint("merge") for x in ("word", "next"))
        both = raw.where("next is not null").groupBy("word", "next").agg(F.sum("n").alias("n")).join(one, "word").join(two, "next")
        for r in both.groupBy("of_word", "of_next").agg(F.sum("n").alias("n")).collect():
            table[r["of_word"], r["of_next"]] += r["n"]
        n_types = np.zeros(every)
        for r in self.others.groupBy("class").agg(F.count("*").alias("n")).collect():
            n_types[r["class"]] = r["n"]
        drop(self.spark, "near")
        return table, n_types

    def _frequent(self, known: int) -> list[tuple[bytes, int]]:
        """The most frequent words, at most ``known`` of them: those above the count from which on there are so many. Counts are put into geometric classes (some thousands at most), so no task or driver sorts the vocabulary."""
        step = F.floor(F.log2(F.col("c").cast("double")) * 64)
        sizes = sorted(((r["step"], r["n"]) for r in self.vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
        least, held = None, 0
        for k, n in sizes:
            if held + n > known:
                break
            least, held = k, held + n
        if least is None:
            return []
        found = self.vocabulary.where(step >= least).select("word", "c").toArrow()
        return sorted(zip(found.column("word").to_pylist(), found.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))

    def score(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """``id, n_tokens, n_known, base_score, score`` for each row."""
        shared, n, v = self.spark.sparkContext.broadcast(self._worker), self.n, self.v

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            symbols, of, step, under, counts, ends = shared.value
            logs = np.log10(counts + 1.0)
            base_under = np.log10(n + v + 1.0)
            held, end = len(counts), len(of) - 1
            for b in (big.slice(lo, ROWS) for big in batches for lo in range(0, big.num_rows, ROWS)):
                scored, beside, words, times, numbers, endings, sizes = [], [], [], [], [], [], [0]
                for run_ in symbols.runs(b.column(1)):
                    s = run_.codes
                    c, other = of[s], (s >= held) & (s < end)
                    top = np.zeros(len(s))
                    known = (s < held)
                    top[known] = logs[s[known]]
                    sure = ~(other[:-1] | other[1:])
                    size = np.diff(run_.ends)
                    base = run_.by_text(top[1:])
                    under_known = np.where(known, under[c], 0.0)[1:]
                    score = base + run_.by_text(np.where(sure, step[c[:-1], c[1:]], 0.0) - under_known)
                    scored.append((size, size - 1 - run_.by_text(other[1:].astype(np.int64)) + (ends > 0), base + np.log10(ends + 1.0) - size * base_under, score))
                    # Words that aren't held: their classes are found by a join; pairs beside them hold classes, or -1 - their number in the text.
                    p = np.flatnonzero(other)
                    of_text = np.searchsorted(run_.ends, p) - 1
                    place = np.empty(len(p), np.int64)
                    now, number = -1, {}
                    counts = np.zeros(len(size), np.int64)
                    for i, (text, at) in enumerate(zip(of_text.tolist(), run_.place[p].tolist(), strict=True)):
                        if text != now:
                            if now >= 0:
                                words += number
                                counts[now] = len(number)
                            now, number = text, {}
                        place[i] = number.setdefault(run_.words[at], len(number))
                    if now >= 0:
                        words += number
                        counts[now] = len(number)
                    first = np.concatenate([[0], np.cumsum(counts)])
                    each_word = first[of_text] + place
                    times.append(np.bincount(each_word, minlength=first[-1]))
                    numbers.append(np.arange(first[-1]) - np.repeat(first[:-1], counts))
                    ending = np.zeros(first[-1], np.int64)
                    ending[each_word] = c[p]
                    endings.append(ending)
                    sizes += (sizes[-1] + first[1:]).tolist()
                    c = c.copy()
                    c[p] = -1 - place
                    left, right = c[:-1][~sure].astype("<i4"), c[1:][~sure].astype("<i4")
                    cuts = np.concatenate([[0], np.cumsum(run_.by_text((~sure).astype(np.int64)))]).tolist()
                    beside += [np.concatenate([left[i:j], right[i:j]]).tobytes() if j > i else None for i, j in zip(cuts, cuts[1:], strict=False)]
                flat = [np.concatenate([np.empty(0, np.int64), *x]) for x in (times, numbers, endings)]
                each = pa.StructArray.from_arrays([pa.array(words, pa.binary()), *map(pa.array, flat)], names=["word", "times", "number", "ending"])
                cols = [pa.array(np.concatenate([np.empty(0, k), *x]).astype(k)) for x, k in zip(zip(*scored, strict=True) if scored else [()] * 4, (np.int64, np.int64, float, float), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(beside, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each)], names=["id", "n_tokens", "n_known", "base", "score", "beside", "rare"])
            pa.default_memory_pool().release_unused()

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, _, step, under, _, _ = shared.value
            for b in batches:
                score = b.column(4).to_numpy(zero_copy_only=False).copy()
                lists = b.column(6)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat, first = lists.flatten(), np.concatenate([[0], np.cumsum(sizes)])
                row = np.repeat(np.arange(len(sizes)), sizes)
                number, times, found = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("number", "times", "class"))
                score -= np.bincount(row, times * under[found], len(sizes))
                own = np.zeros(len(number) + 1, np.int64)
                own[first[row] + number] = found
                for i, beside in enumerate(b.column(5).to_pylist()):
                    if beside is not None:
                        c = np.frombuffer(beside, "<i4").reshape(2, -1).astype(np.int64)
                        c = np.where(c < 0, own[np.where(c < 0, first[i] - 1 - c, 0)], c)
                        score[i] += step[c[0], c[1]].sum()
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(score, pa.float64())], names=["id", "n_tokens", "n_known", "base_score", "score"])

        held = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        id_type = held.schema["id"].dataType.simpleString()
        part = held.mapInArrow(run, f"id {id_type}, n_tokens long, n_known long, base double, score double, beside binary, rare array<struct<word:binary,times:long,number:long,ending:long>>")
        part = stage(part.select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
        rare = part.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(self.others.hint("merge"), "word", "left")
        found = F.collect_list(F.struct("number", "times", F.coalesce("class", "ending").alias("class")))
        rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("log"), found.alias("found"))
        both = part.drop("rare").join(rare, "row", "left")
        more = lambda c: F.coalesce(F.col(c), F.lit(0))
        whole = both.select("id", "n_tokens", (F.col("n_known") + more("more")).alias("n_known"), (F.col("base") + more("log")).alias("base_score"), (F.col("score") + more("log")).alias("score"), "beside", "found")
        return whole.mapInArrow(rest, f"id {id_type}, n_tokens long, n_known long, base_score double, score double")


def fold(id_col: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(folds))
