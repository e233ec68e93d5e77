"""Vector bin packing of examples into training sequences, by the dot-product heuristic.

A sequence has three limits that hold together: tokens, segments (pieces of examples) and
tokens that bear loss. One sequence is open at a time. Of the examples in a window the one
whose demand has the largest weighted dot product with what is left of the three limits is
placed, until none fits; weights are the window's mean demands, so the scarcest limit counts
most. What is left open is filled with the front of the longest example. A sequence that
still is not full goes out at the largest power of two that it reaches, the rest goes back to
the window; fewer than ``least`` missing tokens are left as padding instead.

Every input partition packs its own rows in one pass, without a shuffle and with a window
of bounded size, so a lost task is packed again by itself. Sequences are numbered by partition.

Defined results: a null or empty text is the end id alone; an example without tokens has no
pieces; ids may be null or repeated, every row is an example of its own; an example over a
limit is cut into pieces that keep it; an empty table gives an empty result; only the named
columns are read, others may have any name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import ship

MAX_UNITS = 400_000
LONG_UNIT = 64
#: Units that are encoded in one call.
JOINED = 500
# Letters that are their own normal form, each with one lower-case letter, and further characters that are neither letters nor numbers.
LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
UNIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LATIN}]+|[0-9]|[^\s{LATIN}0-9]+")
OTHER = re.compile(rf"[^{LATIN}\t\n\x0b\f\r\x20-\x7e¡¿«»·–—‘’“”…]")
WORD = re.compile(r"[^\t\n\x0b\f\r\x20]+")
#: How the vocabulary's special tokens begin.
SPECIAL = "<|"
#: Results leave a task in batches of about this many bytes.
OUT_BYTES = 8_000_000
#: Sequences a partition can number.
SEQUENCES = 2**36
#: The size of a place in the window whose piece is used.
GONE = 1e18


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are 1 or more")


class Words:
    """Ids of the pre-tokenizer's units as bytes; each is encoded by the library once a worker and kept in a bounded table.

    Texts of Latin letters, ASCII and common punctuation, which no normal form changes, are
    parted as the pre-tokenizer does it; other texts at white space only, which it drops, so
    that a word's ids never depend on its neighbours.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.held, self.older = Tokenizer.from_file(path), {}, {}
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True

    def units(self, text: str) -> list[str]:
        return WORD.findall(text) if OTHER.search(text) or SPECIAL in text else UNIT.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.units(t) for t in texts]
        if len(self.held) > MAX_UNITS:  # units that do not come again go with the older half
            self.held, self.older = {}, self.held
        held, older, more = self.held, self.older, {}
        new = set().union(*split).difference(held)
        again = new.intersection(older)
        held.update(zip(again, map(older.__getitem__, again), strict=True))
        new = list(new - again)
        for unit, ids in zip(new, self._ids(new), strict=True):
            (held if len(unit) <= LONG_UNIT else more)[unit] = ids
        if not more:
            return [b"".join(map(held.__getitem__, u)) for u in split]
        return [b"".join([held[w] if len(w) <= LONG_UNIT else more[w] for w in u]) for u in split]

    def _ids(self, new: list[str]) -> list[bytes]:
        """Many units at a time, parted where a word ends; those of several words one by one."""
        out: list[bytes] = []
        for lo in range(0, len(new), JOINED):
            part = new[lo : lo + JOINED]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")  # without offsets
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(part) and all(UNIT.fullmatch(w) for w in part):
                data, end = ids.tobytes(), 4 * last
                out += [data[a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
            else:
                out += [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
        return out


@cache
def words_of(path: str) -> Words:
    """One for each worker process."""
    return Words(path)


def tokenize(docs: DataFrame, tokenizer: str, *, text_col: str = "text", ids_col: str = "ids", end_id: int | None = 2, slice_rows: int = 500) -> DataFrame:
    """``docs`` with ``ids_col`` in place of ``text_col``: a text's ids, then ``end_id``, as little-endian unsigned 32-bit numbers. ``tokenizer`` is a path that every worker has."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    keep = [c for c in docs.columns if c.lower() not in (text_col.lower(), ids_col.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words_of(tokenizer)
        for whole in batches:
            for lo in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(lo, slice_rows)
                ids = [x + end for x in own.encode([t or "" for t in batch.column("_text").to_pylist()])]
                first, size = 0, 0
                for i, x in enumerate([*ids, None]):
                    if x is None or size + len(x) > OUT_BYTES and i > first:
                        part = batch.slice(first, i - first)
                        yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array(ids[first:i], pa.binary())], names=[*keep, ids_col])
                        first, size = i, 0
                    size += len(x or b"")

    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name in keep]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(ids_col, T.BinaryType())]))


@dataclass
class Piece:
    """Tokens ``start`` to ``end`` of an example; ``loss[i]`` is how many of its first i tokens bear loss (None: all)."""

    key: Any
    ids: np.ndarray
    loss: np.ndarray | None
    start: int
    end: int

    def __len__(self) -> int:
        return self.end - self.start

    @property
    def bearing(self) -> int:
        return len(self) if self.loss is None else int(self.loss[self.end] - self.loss[self.start])

    def reach(self, tokens: int, loss: int) -> int:
        """The largest front that keeps both limits."""
        end = min(self.end, self.start + tokens)
        if self.loss is None:
            return min(end - self.start, loss)
        return min(end, int(np.searchsorted(self.loss, self.loss[self.start] + loss, "right")) - 1) - self.start

    def cut(self, n: int) -> tuple[Piece, Piece]:
        at = self.start + n
        return Piece(self.key, self.ids, self.loss, self.start, at), Piece(self.key, self.ids, self.loss, at, self.end)


class Packer:
    """Packs the examples of one task, of which a window of pieces is held."""

    def __init__(self, limits: Limits, window: int, least: int):
        self.limits, self.least = limits, least
        self.window = max(window, 2)
        self.held: list[Piece] = []
        self.size = np.zeros((0, 3))
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, key: Any, ids: np.ndarray, loss: np.ndarray | None) -> Iterator[list[Piece]]:
        """Take an example in; sequences that are complete come out."""
        rest = Piece(key, ids, loss, 0, len(ids))
        while len(rest):
            piece, rest = rest.cut(rest.reach(self.limits.tokens, self.limits.loss))
            if len(piece) == self.limits.tokens:
                yield [piece]
            else:
                self.held.append(piece)
        if len(self.held) >= self.window:
            yield from self.drain(self.window // 2)

    def drain(self, left: int = 0) -> Iterator[list[Piece]]:
        """Make sequences until no more than ``left`` pieces are held."""
        self.size = np.array([(len(p), 1, p.bearing) for p in self.held], float).reshape(-1, 3)
        while (live := self.size[:, 0] < GONE).sum() > left:
            yield self._sequence(live)
        self.held = [p for p, on in zip(self.held, live, strict=True) if on]

    def _set(self, i: int, piece: Piece) -> None:
        self.held[i], self.size[i] = piece, (len(piece), 1, piece.bearing)

    def _sequence(self, live: np.ndarray) -> list[Piece]:
        share = self.size / self.capacity
        weight = share[live].mean(0) / self.capacity
        room, chosen = self.capacity.copy(), []
        while room[0] > 0 and room[1] > 0:
            fits = (self.size <= room).all(1)
            i = int(np.where(fits, share @ (weight * room), -1.0).argmax())
            if not fits[i]:
                break
            room -= self.size[i]
            chosen.append((i, self.held[i]))
            self.size[i] = GONE
        while room[0] >= self.least and room[1] > 0:
            length = np.where(self.size[:, 0] < GONE, self.size[:, 0], 0)
            i = int(length.argmax())
            n = min(self.held[i].reach(int(room[0]), int(room[2])), int(length[i]) - self.least)
            if n < self.least:
                break
            front, back = self.held[i].cut(n)
            room -= (n, 1, front.bearing)
            chosen.append((i, front))
            self._set(i, back)
        full = sum(len(p) for _, p in chosen)
        if self.limits.tokens - full >= self.least and full & (full - 1):
            self._shorten(chosen, full - (1 << full.bit_length() - 1))
        return [p for _, p in chosen]

    def _shorten(self, chosen: list[tuple[int, Piece]], excess: int) -> None:
        """Give the last ``excess`` tokens back to the window."""
        while excess:
            i, back = chosen.pop()
            if len(back) > excess:
                front, back = back.cut(len(back) - excess)
                chosen.append((i, front))
            excess -= len(back)
            if self.size[i, 0] < GONE:  # the rest of this example is still held: the two are one again
                back = Piece(back.key, back.ids, back.loss, back.start, self.held[i].end)
            self._set(i, back)


def pack(rows: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", loss_col: str | None = None, limits: Limits = Limits(), window: int = 1024, least: int = 32) -> DataFrame:
    """A row for each piece: ``id_col, start, length, ids, loss, doc_tokens, sequence_id, offset``.

    ``ids_col`` holds little-endian unsigned 32-bit ids; ``loss_col`` a byte for each of them,
    not 0 where the token bears loss (None: all bear it). ``loss`` counts those of the piece.
    A column of masks must be as long as its ids.
    """
    kind = rows.schema[id_col].dataType
    columns = [F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids_col}`").alias("_ids"), (F.lit(None).cast("binary") if loss_col is None else F.col(f"`{loss_col}`")).alias("_loss")]
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("loss", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(limits, window, least), TaskContext.get().partitionId() * SEQUENCES
        out: list[tuple] = []
        size, key_type = 0, None

        def flush() -> pa.RecordBatch:
            kinds = [key_type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 4]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.name for f in schema.fields])
            out.clear()
            return made

        def sequences() -> Iterator[list[Piece]]:
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field(0).type
                for key, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    loss = None if mask is None else np.concatenate([[0], np.cumsum(np.frombuffer(mask, "u1") != 0)])
                    got = np.frombuffer(ids or b"", "<u4")
                    if loss is not None and len(loss) != len(got) + 1:
                        raise ValueError(f"{len(got)} ids and {len(loss) - 1} of loss")
                    yield from packer.add(key, got, loss)
            yield from packer.drain()

        for pieces in sequences():
            offset = 0
            for p in pieces:
                ids = p.ids[p.start : p.end].tobytes()
                out.append((p.key, p.start, len(p), ids, p.bearing, len(p.ids), number, offset))
                offset, size = offset + len(p), size + len(ids) + 64
            number += 1
            if size > OUT_BYTES:
                yield flush()
                size = 0
        if out:
            yield flush()

    ship(rows.sparkSession)
    return rows.select(*columns).mapInArrow(run, schema)


def assemble(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, lengths, ids``: each sequence's ids as one value, and the lengths of its segments. A group holds a sequence, which its limits bound."""
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return held.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"), F.transform("p", lambda x: x["length"]).alias("lengths"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
