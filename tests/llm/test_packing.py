"""Packing: an exact round trip of every id, the three limits, and odd rows."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm.packing import Limits, Packer, assemble, pack, tokenize
from orrery.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"


def library_ids(texts):
    from tokenizers import Tokenizer

    return [[*e.ids, 2] for e in Tokenizer.from_file(P.path("word_bpe_49k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def held_together(pieces, limits, least=32):
    """Sequences are gapless and keep the limits; the share of padding."""
    by, padding = {}, 0
    for r in pieces:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1]]
        n = sum(r.length for r in rows)
        assert n <= limits.tokens and len(rows) <= limits.segments
        missing = limits.tokens - n if n & (n - 1) else 0
        assert missing < least
        padding += missing
    return padding / max(1, sum(r.length for r in pieces))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_is_whole(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_packing"](spark, DIR).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
    for (doc, _), ids in zip(docs.items(), library_ids(docs.values()), strict=True):
        own = sorted(parts.pop(doc), key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert not parts and held_together(rows, Limits()) < 0.002


@pytest.mark.parametrize(("limits", "mean", "bears"), [(Limits(4096, 256, 4096), 900, None), (Limits(1024, 8, 300), 90, 0.5), (Limits(64, 3, 64), 200, 0.2), (Limits(4096, 64, 4096), 4, None), (Limits(7, 1, 1), 5, 0.5)])
def test_packer_keeps_all_limits(limits, mean, bears):
    rng, packer, docs, out = np.random.default_rng(3), Packer(limits, 128, 4), [], []
    for k in range(1500):
        ids = rng.integers(0, 50_000, 1 + int(rng.exponential(mean))).astype("<u4")
        loss = None if bears is None else np.concatenate([[0], np.cumsum(rng.random(len(ids)) < bears)])
        docs.append(ids)
        out += packer.add(k, ids, loss)
    out += packer.drain()
    got = {}
    for pieces in out:
        assert pieces and sum(map(len, pieces)) <= limits.tokens and len(pieces) <= limits.segments and sum(p.bearing for p in pieces) <= limits.loss
        for p in pieces:
            got.setdefault(p.key, []).append((p.start, p.end))
    for k, ids in enumerate(docs):
        own = sorted(got[k])
        assert own[0][0] == 0 and own[-1][1] == len(ids) and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_dot_product_mixes_scarce_limits():
    """Many short answers and long prompts: limits are met together, so fewer sequences than by each kind alone."""
    limits, packer, out = Limits(1000, 40, 200), Packer(Limits(1000, 40, 200), 400, 4), []
    for k in range(400):
        n, bearing = (20, 20) if k % 2 else (80, 0)
        out += packer.add(k, np.zeros(n, "<u4"), np.arange(n + 1) if bearing else np.zeros(n + 1, int))
    out += packer.drain()
    assert len(out) <= 24 and sum(len(p) for s in out for p in s) == 200 * 100 and limits.loss == 200


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", None), (2, "", "x"), (3, "word, it's <|endoftext|> 12 ünïcode ﬁ 😀    x", "x"), (4, "tok " * 30_000, "x"), (5, "x" * 3000, "y")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string").repartition(2)
    pieces = pack(tokenize(docs, P.path("word_bpe_49k.json"))).collect()
    got = {}
    for r in pieces:
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for key, text in {r[0]: r[1] for r in rows}.items():
        want = np.array(library_ids([text])[0], "<u4").tobytes()
        assert b"".join(b for _, b in sorted(got[key])) == (want * 2 if key == 1 else want)
    held_together(pieces, Limits())
    none = spark.createDataFrame([], docs.schema)
    assert pack(tokenize(none, P.path("word_bpe_49k.json"))).count() == 0


def test_masks_and_whole_sequences(spark):
    rows = [(i, np.arange(n, dtype="<u4").tobytes(), bytes([i % 2]) * n) for i, n in enumerate([5, 900, 0, 70, 300, 12, 2000])] + [(9, None, None)]
    docs = spark.createDataFrame(rows, "id long, ids binary, mask binary")
    pieces = pack(docs, id_col="id", loss_col="mask", limits=Limits(512, 4, 200), least=8).cache()
    assert pieces.agg(F.sum("length"), F.sum("loss")).first() == (3287, 900 + 70 + 12)
    assert all(r["sum(loss)"] <= 200 for r in pieces.groupBy("sequence_id").agg(F.sum("loss")).collect())
    whole = assemble(pieces).collect()
    assert sum(r.n_tokens for r in whole) == 3287 and all(len(r.ids) == 4 * r.n_tokens and sum(r.lengths) == r.n_tokens for r in whole)
    with pytest.raises(Exception, match="of loss"):
        pack(spark.createDataFrame([(1, b"\0" * 8, b"\1")], "id long, ids binary, mask binary"), id_col="id", loss_col="mask").collect()
    with pytest.raises(ValueError):
        Limits(0)


def test_units_are_encoded_without_offsets():
    """The library's plain ``encode`` also keeps each token's place in the text, which nobody asks for."""
    import public_tokenizers
    from orrery.llm.packing import Words

    class Fast:
        def __init__(self, library):
            self.encode_batch_fast = library.encode_batch_fast

    words = Words(public_tokenizers.path("word_bpe_49k.json"))
    library, words.library = words.library, Fast(words.library)
    text = "The quick brown fox isn't 12 years old; naïve Größe, zzyzx-1987 e-mail@example.org!"
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
