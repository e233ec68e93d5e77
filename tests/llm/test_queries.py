"""Each query opN on the smallest tables, against DuckDB or a plain version; and the pipeline's stages."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import duckdb
import pyarrow.parquet as pq
import pytest

from orrery.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
WORD, WHITE = re.compile(r"[^\x20\x09-\x0D]+"), " \t\n\x0b\f\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def read(name):
    return pq.read_table(f"{DIR}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return read("documents")


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def measures(text):
    w = WORD.findall(text or "")
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    return out | {"base_failed": len(w) < 10 or 100 * len(covered) > 20 * len(w)}


def test_op3_measures(spark, docs):
    got = by_id(QUERIES["op3_quality"](spark, DIR))
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert {k: r[k] for k in measures("")} == measures(d["text"]) and not (r["base_failed"] and r["kept"])


def test_op4_articles(spark):
    got = by_id(QUERIES["op4_html_text"](spark, DIR), "page_id")
    for p in read("pages"):
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", p["html"] or "", re.DOTALL)
        parts = re.split(r"</?(?:p|h\d|article|ul|li|div|table|tr|td)\b[^>]*>", body[1] if body else "")
        blocks = [" ".join(unescape(re.sub(r"<br[^>]*>", " ", x) if "<br" in x else x).split()) for x in (re.sub(r"</?(?!br)[a-z][^>]*>", "", x) for x in parts)]
        want = "\n\n".join(b for b in blocks if b)
        r = got[p["page_id"]]
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == p["url"]


def test_op5_is_the_library(spark, docs):
    import sentencepiece
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = by_id(QUERIES["op5_pieces"](spark, DIR))
    for d in docs:
        ids = library.encode(d["text"] or "")
        assert got[d["doc_id"]] == {"doc_id": d["doc_id"], "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(library.decode(ids))}


def test_op6_base(spark, docs):
    got = by_id(QUERIES["op6_class_lm"](spark, DIR))
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2 for d in docs}
    tokens = {d["doc_id"]: [*WORD.findall((d["text"] or "").translate(LOWER)), None] for d in docs}
    c = Counter(t for i, ts in tokens.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    model = base = 0.0
    for i, ts in tokens.items():
        r = got[i]
        want = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(c[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(want) and r["score"] < 0
        if held[i]:
            model, base = model + r["score"], base + want
    assert model > base


def test_op9_shares(spark, docs):
    got = by_id(QUERIES["op9_mix"](spark, DIR))
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    held = Counter()
    for d in docs:
        held[d["source"]] += size[d["doc_id"]]
    order = sorted(held, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(held.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * held[s]}
        for s in full or open_:
            target[s] = 3.0 * held[s] if full else share * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for d in docs:
        r = got[d["doc_id"]]
        assert r["size"] == size[d["doc_id"]] and r["source_size"] == held[d["source"]] and r["target"] == pytest.approx(target[d["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 200 + 0.02 * target[s] for s in order)
    assert got == by_id(QUERIES["op9_mix"](spark, DIR))


BASE = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= least)


def test_op10_base(spark, docs):
    got = by_id(QUERIES["op10_secrets"](spark, DIR))
    for d in docs:
        r, spans = got[d["doc_id"]], base_spans(d["text"])
        assert [r[f"n_{k}"] for k, *_ in BASE] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r["base_sha256"] == sha(",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("markov")] == [f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans]


def line_dedup(rows):
    key = lambda s: s.strip(WHITE).translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            held[key(s)].add(i)
    return [(i, "\n".join(s for s in (t or "").split("\n") if len(key(s)) < 20 or len(held[key(s)]) < 3 or max(held[key(s)]) == i)) for i, t in rows]


def near_kept(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            at[x].append(k)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in enumerate(sets):
        for b, c in Counter(k for x in s for k in at[x] if k < a).items():
            if 100 * c >= 80 * (len(s) + len(sets[b]) - c):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), (i, k)), (i, k))
    return [r for k, r in enumerate(rows) if not sets[k] or best[find(k)][1] == k]


def test_pipeline_stages(spark, tmp_path, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece
    import public_tokenizers

    frames, frame = {}, spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, frame, DIR).write.parquet(f"{tmp_path}/{name}")
        frame = frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
    rows = lambda name: sorted((r["doc_id"], r["text"]) for r in frames[name].collect())
    # No cutoff can stand on so few labels: the base rule alone decides.
    kept = [(d["doc_id"], d["text"]) for d in docs if not measures(d["text"])["base_failed"]]
    assert rows("quality") == sorted(kept)
    lines = line_dedup(sorted(kept))
    assert rows("line_dedup") == lines
    near = near_kept(lines)
    assert rows("near_duplicates") == near
    words = {i: WORD.findall(t or "") for i, t in near}
    mixed, taken = rows("mix"), Counter()
    for i, t in mixed:
        own = WORD.findall(t)
        taken[i] += len(own)
        assert own and any(words[i][k : k + len(own)] == own for k in range(len(words[i]) - len(own) + 1)) or Counter(own) <= Counter(words[i])
    assert all(taken[i] <= 3 * len(words[i]) for i in taken) and abs(sum(taken.values()) - sum(map(len, words.values()))) <= 0.05 * sum(map(len, words.values()))
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    last = frames["pieces"].collect()
    want = sorted((i, library.encode(t)) for i, t in mixed)
    assert sorted((r["doc_id"], list(r["ids"])) for r in last) == want
    assert all(r["decoded"] == library.decode(list(r["ids"])) and r["n_tokens"] == len(r["ids"]) for r in last)
    # The whole run gives the same rows.
    assert sorted((r["doc_id"], list(r["ids"])) for r in pipeline.run(spark, DIR).collect()) == want


def test_pipeline_keeps_texts_that_share_an_id(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    x, y = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, x), (5, y), (2, y + " tail"), (7, x), (8, ""), (8, None), (5, x), (None, "one two three"), (None, "one two three")]
    got = pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(5, x), (2, y + " tail"), (8, ""), (8, None), (None, "one two three")], key=str)
