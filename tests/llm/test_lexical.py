"""Ranked search against plain scores, pruning, and odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import orrery.llm.lexical as lexical
from orrery.llm.lexical import Group, Queries, packed, search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, queries, k=10):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, length = len(held), sum(s for _, _, s in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text in queries:
        asked, scored = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, c, size in held:
            m = 25 + 75 * size * n // length
            s = sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, a in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "ÉCOLE", "école", "naïve", "x9"]
    return [(i, rng.choice([" ", ", ", "-", "\n", "\x7f"]).join(rng.choices(vocabulary, [1 / (j + 1) for j in range(len(vocabulary))], k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize(("block", "group"), [(256, 128), (4, 3), (1, 1000)])
def test_against_plain_scores(spark, monkeypatch, block, group):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "GROUP", group)
    docs = corpus(300)
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(2000, "W1 w1 w1 " * 20_000), (None, docs[5][1]), (7, docs[9][1])]
    queries = [(i, " ".join(random.Random(i).choices(docs[i][1].split() or ["w0"], k=6))) for i in range(12)] + [(90, docs[5][1]), (91, None), (92, "zzz unknown"), (93, "w1 W1 école ÉCOLE"), (93, "w2"), (93, "w2"), (None, "w3 w4")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    assert Counter(map(tuple, search(d, q).collect())) == plain(docs, queries)


def test_batches_of_queries(spark):
    docs, queries = corpus(60), [(i, f"w{i} w{i + 1} w0") for i in range(9)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id int, text string")
    assert Counter(map(tuple, search(d, q, k=3, batch_bytes=200).collect())) == plain(docs, queries, 3)


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, " -- ", "q")], "doc_id long, text string, query string")
    q = spark.createDataFrame([(1, "a", "x")], "item_id long, text string, rank string")
    assert search(d, q).count() == search(d.limit(0), q).count() == search(d, q.limit(0)).count() == 0
    one = search(spark.createDataFrame([(5, "A b", "z")], "doc_id long, text string, score string"), q)
    assert one.columns == ["query_id", "rank", "id", "score"] and [r[:3] for r in map(tuple, one.collect())] == [(1, 1, 5)]


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(0x2100))) + "ABC abc-DEF x y 😀z"
    assert [t.decode() for t in terms(text.encode())] == TERM.findall(text.translate(LOWER))


def test_bounds_hold_and_blocks_are_left_out():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(20):
        doc = [np.unique(rng.integers(0, 50, 8)) for _ in range(6)]
        term, impact = np.concatenate(doc), rng.integers(1, 1000, sum(map(len, doc)))
        top = {t: impact[term == t].max() for t in np.unique(term)}
        rows.append({"ids": packed(range(6)), "known": packed([1] * 6), "ends": packed(np.cumsum([len(x) for x in doc])), "terms": packed(term), "impact": packed(impact), "max_terms": packed(list(top)), "max_impact": packed(list(top.values()))})
    group, weight = Group(rows), np.zeros(50, np.int64)
    own = np.array([3, 17, 40])
    weight[own] = [5, 1, 9]
    bound = group.bounds(own, weight[own])
    best = [group.scores(i, weight).max() for i in range(20)]
    assert all(b >= s for b, s in zip(bound, best, strict=True)) and (bound < max(best)).any()


def test_repeats_of_a_query_count():
    q = Queries([b"b a b", b"", b"c"])
    assert q.number == {b"a": 0, b"b": 1, b"c": 2} and q.repeats[0].tolist() == [1, 2] and not len(q.terms[1])
