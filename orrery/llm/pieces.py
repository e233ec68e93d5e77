"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one a code point, with U+2581 for each space and one in front. An
agenda holds the adjacent pairs of symbols that form a piece, ordered by score and then by
place; the first is merged, its neighbours enter new pairs, until none is left. Symbols
outside the vocabulary fall back to bytes.

No piece of such a vocabulary goes over a line end, from a Latin letter to another character, or
from any character to a space (this is checked when it is loaded), so merges in one word
never touch another, and a text is encoded word by word. Each word is encoded once a worker
and kept in a bounded table; the new ones of every Arrow batch are checked against the
sentencepiece library, and a difference ends the job. A vocabulary that fails the condition
is encoded text by text.

Defined results: a null or empty text has no ids; no ids give an empty text; rows are
encoded alone, so ids may be null or repeated; an empty table gives an empty result;
further columns pass through unless named as an output.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .store import ship

SPACE = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
MAX_WORDS = 500_000
SHORT = 40
SLICE = 1000
# Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary:
    """A merge-type model file, read as it is."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix or not train.byte_fallback or {USER, UNUSED} & kinds:
            raise ValueError("only merge-type vocabularies with byte fallback, a leading space and no normalisation")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        # The place of a piece in order of falling score: what the agenda is ordered by.
        by_score = sorted(set(p.score for p in model.pieces if p.type == NORMAL), reverse=True)
        rank = {s: k for k, s in enumerate(by_score)}
        self.rank = {p.piece: rank[p.score] for p in model.pieces if p.type == NORMAL}
        self.bytes = [0] * 256
        self.surface: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == CONTROL:
                self.surface.append(b"")
            elif p.type == UNKNOWN:
                self.surface.append(train.unk_surface.encode())
            else:
                self.surface.append(p.piece.replace(SPACE, " ").encode())
        across = re.compile(f"\n|[^{SPACE}]{SPACE}|[{LETTERS}][^{LETTERS}]")
        self.by_word = not any(across.search(p) for p in self.ids)

    def merge(self, text: str) -> list[int]:
        """The ids of a text with spaces escaped."""
        return self._ids(self._merged_short(list(text)) if len(text) <= SHORT else self._merged(list(text)))

    def _merged_short(self, sym: list[str]) -> list[str]:
        """The agenda as a list by place, which for a few symbols is faster than a heap."""
        rank, none = self.rank, len(self.rank)
        agenda = [rank.get(a + b, none) for a, b in zip(sym, sym[1:], strict=False)]
        while agenda and (best := min(agenda)) != none:
            i = agenda.index(best)
            sym[i : i + 2] = [piece := sym[i] + sym[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank.get(piece + sym[i + 1], none)
            if i:
                agenda[i - 1] = rank.get(sym[i - 1] + piece, none)
        return sym

    def _merged(self, sym: list[str]) -> list[str]:
        """The agenda as a heap."""
        rank, n = self.rank, len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := sym[i] + sym[i + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = right[i]
            if not sym[i] or j >= n or sym[i] + sym[j] != piece:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = piece, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (p := piece + sym[k]) in rank:
                    heapq.heappush(agenda, (rank[p], i, p))
            h = left[i]
            if h >= 0 and (p := sym[h] + piece) in rank:
                heapq.heappush(agenda, (rank[p], h, p))
        return [s for s in sym if s]

    def _ids(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is None:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(i)
        return out

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class Words(dict):
    """Ids of words as bytes of int32; what is missing is merged and noted for the check."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.new = vocabulary, []

    def __missing__(self, word: str) -> bytes:
        got = self[word] = np.array(self.vocabulary.merge(word), "<i4").tobytes()
        self.new.append(word)
        return got


class Codec:
    WORD = re.compile(rf"{SPACE}*[^{LETTERS}{SPACE}\n]*[{LETTERS}]+|{SPACE}*[^{LETTERS}{SPACE}\n]+|{SPACE}+|\n")

    def __init__(self, path: str):
        import sentencepiece

        self.vocabulary = Vocabulary(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words = Words(self.vocabulary)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        escaped = SPACE + text.replace(" ", SPACE)
        if not self.vocabulary.by_word:
            return self.words[escaped]
        return b"".join(map(self.words.__getitem__, self.WORD.findall(escaped)))

    def check(self) -> None:
        """Compare the words that are new with the library's ids. A line end in front sets a word apart from the space that the library adds."""
        new, self.words.new = self.words.new, []
        if self.vocabulary.by_word:
            theirs = (ids[2:] for ids in self.library.encode(["\n" + w for w in new], num_threads=1))
        else:
            theirs = iter(self.library.encode([w[1:] for w in new], num_threads=1))
        for word, ids in zip(new, theirs, strict=True):
            if np.array(ids, "<i4").tobytes() != self.words[word]:
                raise ValueError(f"the library encodes {word!r} as {ids}")
        if len(self.words) > MAX_WORDS:
            self.words.clear()


@cache
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids take more room than text: results go out in smaller batches than texts come in."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, c in enumerate(batch.schema.names) if c.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [column], names=[batch.schema.names[i] for i in keep] + [name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def _lists(parts: list[bytes]) -> Iterator[tuple[int, int, pa.Array]]:
    """First and last row and ids of texts, as lists of int32: all at once, or row by row where they are too many for one array."""
    ends = np.zeros(len(parts) + 1, "<i8")
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
    if ends[-1] < 2**31:
        yield 0, len(parts), pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), flat)
    else:
        for i in range(len(parts)):
            yield i, i + 1, pa.ListArray.from_arrays(pa.array([0, len(parts[i]) // 4], pa.int32()), flat.slice(int(ends[i]), len(parts[i]) // 4))


def encode(docs: DataFrame, model: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` in ``ids_col``. ``model`` is a path that every worker has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in _slices(batches):
            parts = [own.encode(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            own.check()
            for lo, hi, ids in _lists(parts):
                yield _with(batch.slice(lo, hi - lo), ids_col, ids)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, _schema(docs, ids_col, T.ArrayType(T.IntegerType(), False)))


def recode(docs: DataFrame, model: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` without ``text_col``, with its ids in ``ids_col`` and the text of these in ``decoded_col``: ``encode`` and ``decode`` by one worker a task, so that one table of words is held and ids are not sent from worker to worker."""
    gone = {c.lower() for c in (text_col, ids_col, decoded_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in _slices(batches):
            parts = [own.encode(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            own.check()
            keep = [i for i, c in enumerate(batch.schema.names) if c.lower() not in gone]
            for lo, hi, ids in _lists(parts):
                texts = [own.vocabulary.decode(np.frombuffer(p, "<i4").tolist()) for p in parts[lo:hi]]
                yield pa.RecordBatch.from_arrays([batch.column(i)[lo:hi] for i in keep] + [ids, pa.array(texts, pa.string())], names=[batch.schema.names[i] for i in keep] + [ids_col, decoded_col])

    ship(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name.lower() not in gone]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded_col, T.StringType())]))


def decode(encoded: DataFrame, model: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids_col`` in ``text_col``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = codec(model).vocabulary
        for batch in _slices(batches):
            texts = [vocabulary.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in batch.column(batch.schema.get_field_index(ids_col))]
            yield _with(batch, text_col, pa.array(texts, pa.string()))

    ship(encoded.sparkSession)
    return encoded.mapInArrow(run, _schema(encoded, text_col, T.StringType()))
