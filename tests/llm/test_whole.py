"""The whole job, where a bound or a shortcut once left a part of it undone."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm.class_lm import ClassLM, Symbols, coded, decoded, exchange
from orrery.llm.html_text import extract
from orrery.llm.vector_dedup import near_vectors


@pytest.mark.parametrize("known", [16, 1000])
def test_every_word_has_a_class_of_its_own_counts(spark, known):
    rng = np.random.default_rng(4)
    # Two kinds of words with the same endings, two of each among the frequent ones; each kind has its own neighbours.
    kinds = [[f"{k}{i}same" for i in range(30)] for k in "xy"]
    texts = []
    for _ in range(600):
        k = int(rng.integers(0, 2))
        texts.append(" ".join(w for _ in range(4) for w in (f"{'lm'[k]}{rng.integers(0, 3)}", kinds[k][rng.integers(0, 2 if rng.random() < 0.5 else 30)], f"{'rs'[k]}{rng.integers(0, 3)}")) + (f" {kinds[k][0]} {kinds[k][1]}" if rng.random() < 0.3 else ""))
    model = ClassLM(spark.createDataFrame([(t,) for t in texts], "text string"), clustered=16, endings=4, classes=6, known=known)
    asked = ["l0 x3same r1", "l0 y3same r1", "m0 y4same s0", "m0 x4same s0", "x5same y5same", "new x6same newer r0", "x7same neither y7same", ""]
    got = {r.id: r for r in model.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")).collect()}
    assert got[0].score > got[1].score + 0.5 and got[2].score > got[3].score + 0.5
    # The table and the scores, from the classes by plain counting.
    of = model.classes | {bytes(r["word"]): r["class"] for r in model.others.collect()}
    c = Counter(w for t in texts for w in t.encode().split())
    assert set(of) == set(c) and len({of[w.encode()] for w in kinds[0]}) == len({of[w.encode()] for w in kinds[1]}) == 1
    table = np.zeros((7, 7))
    for t in texts:
        s = [6, *(of[w] for w in t.encode().split()), 6]
        np.add.at(table, (s[:-1], s[1:]), 1)
    uses = table.sum(0)
    step = np.log10((table + 20 * (uses + 1) / (uses.sum() + 7)) / (table.sum(1, keepdims=True) + 20))
    under = np.log10(uses + np.bincount(list(of.values()), minlength=7) + 1)
    symbols, codes = model._worker[0], model._worker[1]
    assert isinstance(symbols, Symbols)
    for i, t in enumerate(asked):
        ws = t.encode().split()
        own = [of[w] if w in of else int(codes[Symbols([], 4)[w] + symbols.first]) for w in ws]
        s = [6, *own, 6]
        want = step[s[:-1], s[1:]].sum() + sum(np.log10(c[w] + 1) - under[k] for w, k in zip(ws, own, strict=True))
        assert got[i].score == pytest.approx(want) and got[i].n_known == sum(w in c for w in ws) + 1


def test_class_lm_reads_its_texts_twice(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    texts = ["a b c", "b a  RARE rarer a", "", None, "c rarer", "last a b\n c"] * 3
    model = ClassLM(spark.createDataFrame([(t,) for t in texts], "text string").select(seen.asNondeterministic()("text")), clustered=2, endings=4, classes=2, known=3)
    assert read.value == 2 * len(texts)
    assert {bytes(r["word"]): r["c"] for r in model.others.collect()} == {b"rare": 3, b"last": 3, b"rarer": 6} and model.n == 14 * 3 + len(texts)


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_codes_of_texts_are_read_back(most):
    symbols = Symbols([b"a", b"b"], 4)
    column = pa.array(["a x b", None, "", "y", "b zz\u00a0 a"], pa.string())
    run = next(symbols.runs(column))
    codes, others = coded(run, 2)
    for lo, n in ((0, 5), (1, 4), (3, 1), (0, 0)):
        want = list(symbols.runs(column.slice(lo, n)))
        got = list(decoded(codes.slice(lo, n), others.slice(lo, n), most))
        assert [c for s, _ in got for c in s[1:]] == [c for r in want for c in r.codes[1:]] and all(s[0] == s[-1] == 6 for s, _ in got)
        assert [w for _, ws in got for w in ws] == [w for r in want for w in r.words if w not in symbols.own]


def test_exchange_ends_where_no_move_gains():
    rng = np.random.default_rng(8)
    pairs = rng.poisson(np.exp(rng.normal(0, 1.5, (61, 61))))
    of = exchange(pairs, 8)

    def likelihood(c):
        m = np.eye(9)[c]
        t = m.T @ pairs @ m
        phi = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return phi(t) - phi(t.sum(0)) - phi(t.sum(1))

    best = likelihood(of)
    assert best >= likelihood(exchange(pairs, 8, 1))
    for w in range(60):
        for b in range(8):
            other = of.copy()
            other[w] = b
            assert likelihood(other) <= best + 1e-3


@pytest.mark.parametrize("n", [2, 200])
def test_vectors_in_one_narrow_cone(spark, n):
    rng = np.random.default_rng(6)
    x = np.array([[1.0, 0.0, 0.0], [0.96, 0.28, 0.0]]) if n == 2 else rng.normal(size=16) + 0.12 * rng.normal(size=(n, 16))
    got = {r.id: r for r in near_vectors(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    assert links.sum() > 0 and [got[i].n_links for i in range(n)] == links.tolist()


@pytest.mark.parametrize("word", ["has-sidebar", "with-comments", "no-ads"])
def test_html_article_in_a_wrapper_named_for_something_else(word):
    aside = "<div class='comments'><article class='comment'>" + "no " * 50 + "</article></div>"
    assert extract(f"<div class='{word}'><article><h1>T</h1><p>b</p></article>{aside}</div>", None) == ["T", "b"]
    assert extract(f"<div class='{word}'><h1>T</h1><p>{'b ' * 90}</p><div class=related>no</div></div><nav>no</nav>", None) == ["T", ("b " * 90).strip()]


def test_html_links_of_articles():
    title = "<article><h1><a href=x>Title {0}</a></h1><p><a href=y>linked {0}</a></p></article>"
    assert wrapped([title.format(0)])(title.format(0)) == ["Title 0", "linked 0"]
    page = "<article><h1><a href=x>Title {0}</a></h1></article><p>{1}</p>"
    many = wrapped([page.format(i, f"<a href=z>more {i}</a>") for i in range(8)])
    assert many(page.format(9, "<a href=z>more 9</a>")) == ["Title 9"]


def wrapped(pages, least=5):
    """``extract`` with the wrappers of a host that has these pages."""
    from orrery.llm import html_text as h

    skeletons = h.layouts(sorted(set(pages)), least)
    if not skeletons:
        return lambda html: extract(html, None)
    text = h.json.dumps(skeletons)
    trees = h._trees(text)
    counts = [np.zeros((sum(1 for _ in h._walk(t)), len(h.COUNTS)), np.int64) for t in trees]
    for p in pages:
        which, found = h.count_page(p, trees)
        for at, *values, share in found:
            counts[which][at] += (h.PARTS, *(h.PARTS * v for v in values), share)
    made = h._trees(h.json.dumps([h.decide(t, c, least) for t, c in zip(trees, counts, strict=True)]))
    return lambda html: extract(html, made)


def _words(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


def _made_page(rng, names):
    """A page of a host whose class names tell nothing, and its article."""
    title, blocks = _words(rng, 5), [_words(rng, int(rng.integers(5, 60))) for _ in range(rng.integers(1, 15))]
    nav = "".join(f"<div class={names[0]}i><a href=/{i}>{_words(rng, 1)}</a></div>" for i in range(5))
    body = "".join(f"<h2>{b}</h2>" if k % 5 == 4 else f"<p>{b}</p>" for k, b in enumerate(blocks))
    html = f"<body><div class={names[0]}>{nav}</div><div class={names[1]}>{_words(rng, 8)}</div><div class={names[2]}><h1>{title}</h1>{body}</div><div class={names[3]}><p>{_words(rng, 6)}</p><p>All rights reserved</p></div>"
    return html, [title, *blocks]


@pytest.mark.parametrize("seed", [0])
def test_html_wrapper_decides_where_names_tell_nothing(spark, seed):
    from orrery.llm.html_text import extract_text

    rng = np.random.default_rng(seed)
    rows, want = [], {}
    for host in range(4):
        names = [_words(rng, 1) + str(rng.integers(0, 99)) for _ in range(4)]
        for k in range(40):
            html, article = _made_page(rng, names)
            want[len(rows)] = article
            rows.append((len(rows), f"http://h{host}.example.com/{k}", html))
    got = {r.id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join(a) for i, a in want.items()}
    # Without the wrapper the adverts and menus come back.
    assert all(len(extract(html, None)) > len(want[i]) for i, _, html in rows)


def test_html_repeated_pages_are_one_of_the_sample(spark):
    from orrery.llm.html_text import extract_text

    page = "<div class=q1>See our other sites</div><div class=q2><h1>T {0}</h1><p>" + "text {0} " * 20 + "</p></div>"
    rows = [(i, "http://a.example.com/", page.format(0)) for i in range(60)] + [(100 + i, "http://a.example.com/", page.format(i)) for i in range(1, 12)]
    got = {r.id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 71 and all(t.startswith("T ") and "other sites" not in t for t in got.values())


def test_html_two_layouts_of_a_host(spark):
    from orrery.llm.html_text import extract_text

    one = "<div class=q1>{2}</div><div class=q2><h1>T {0}</h1><p>{1}</p></div>"
    two = "<table><tr><td class=z1>{2}</td></tr><tr><td class=z2><div><p>{1}</p><p>{1}</p></div></td></tr></table>"
    rng = np.random.default_rng(3)
    rows = [(i, "http://a.example.com/", (one if i % 2 else two).format(i, _words(rng, 40), _words(rng, 5))) for i in range(40)]
    got = {r.id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        text = html.split("<p>")[1].split("</p>")[0]
        assert got[i] == (f"T {i}\n\n{text}" if i % 2 else f"{text}\n\n{text}")


def _page_of_layout(rng, depth, names):
    """A page with a menu, a box and a footer whose text varies, in containers that are this layout's own."""
    title, blocks = _words(rng, 5), [_words(rng, int(rng.integers(20, 50))) for _ in range(rng.integers(2, 8))]
    nav = "".join(f"<div class={names[0]}i><a href=/{i}>{_words(rng, 1)}</a></div>" for i in range(5))
    body = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in blocks)
    html = f"<body><div class={names[0]}>{nav}</div><div class={names[1]}>See what others have to say</div>{'<section>' * depth}<div class={names[2]}>{body}</div>{'</section>' * depth}<div class={names[3]}><p>All rights reserved</p></div>"
    return html, "\n\n".join([title, *blocks])


@pytest.mark.parametrize("sizes", [[20] * 10, [100, 20, 20, 20, 20, 20], [5, 10, 15, 20, 25, 25], [9] * 12], ids=["even", "one_large", "uneven", "many"])
def test_html_every_layout_of_a_host(spark, sizes):
    """Names that tell nothing; layouts of 5 % to 50 % of the host's pages, most with fewer than 5 pages of a sample of 24."""
    from orrery.llm.html_text import extract_text

    rng = np.random.default_rng(len(sizes))
    rows, want = [], {}
    for k, n in enumerate(sizes):
        names = [_words(rng, 1) + str(k) for _ in range(4)]
        for _ in range(n):
            html, want[len(rows)] = _page_of_layout(rng, k % 3, names)
            rows.append((len(rows), f"http://a.example.com/{len(rows)}", html))
    got = {r.id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_host_without_layouts(spark):
    """Pages of which each is a layout of its own: sampling ends, and every page keeps its text."""
    from orrery.llm.html_text import extract_text

    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        name = "".join(chr(97 + c) for c in rng.integers(0, 26, 9))
        rows.append((i, "http://a.example.com/", f"<div class={name}><div class={name}b><p>{_words(rng, 30)}</p></div><div class={name}c><div class={name}d>{_words(rng, 9)}</div></div></div>"))
    got = {r.id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join(extract(html, None)) for i, _, html in rows} and all(got.values())


def test_html_unicode_space_and_empty_svg():
    assert extract("<p>a\u2002\u3000b\xa0\u2009c<svg class='i'/><p>d", None) == ["a b c", "d"]


def test_html_page_with_very_many_blocks():
    page = "<div class=a>" + "".join(f"<p>block {i}</p>" for i in range(6000)) + "</div>"
    assert len(wrapped([page.replace("block", w) for w in "abcdefg"])(page)) == 6000


def test_vectors_of_each_length_and_of_repeated_ids(spark):
    rng = np.random.default_rng(12)
    data = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    data += [(109, [1.0, 2.0]), (110, [1.0, 2.001]), (7, [5.0, 0.1, 0.0, 0.0]), (7, [0.0, 0.0, 5.0, 0.1]), (120, [5.0, 0.0, 0.0, 0.0]), (121, [5.0, 0.2, 0.0, 0.0]), (122, [0.0, 0.0, 5.0, 0.0])]
    data += [(200 + i, [1.0] * (5 + i)) for i in range(12)] + [(300 + i, [2.0] * (5 + i)) for i in range(12)] + [(400, [1.0] * 16 + [1.1])]
    got = sorted((r.id, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect())
    ids, n = [d[0] for d in data], len(data)
    unit = [np.array(v) / np.linalg.norm(v) for _, v in data]
    linked = [[i != j and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95 for j in range(n)] for i in range(n)]
    up = list(range(n))
    for _ in range(n):
        up = [min([up[i], *(up[j] for j in range(n) if linked[i][j])]) for i in range(n)]
    least = {c: min(ids[i] for i in range(n) if up[i] == c) for c in set(up)}
    assert got == sorted((ids[i], sum(linked[i]), least[up[i]]) for i in range(n))


@pytest.mark.parametrize(("split", "block"), [(16, 8)])
def test_vectors_in_long_lists(spark, split, block):
    rng = np.random.default_rng(13)
    x = np.concatenate([c + 0.2 * rng.normal(size=(60, 24)) for c in rng.normal(size=(12, 24))])
    x = np.concatenate([x, x[::3] + 0.05 * rng.normal(size=(240, 24)), x[:20]])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in near_vectors(df, split=split, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    found = np.array([got[i] for i in range(len(x))])
    # No split or cut loses or doubles a candidate: all settings find the same links.
    whole = {r.id: r.n_links for r in near_vectors(df, split=10**6).collect()}
    assert found.tolist() == [whole[i] for i in range(len(x))] and (found <= links).all() and found.sum() >= 0.97 * links.sum()


def _near_rows(rng):
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(15):
        own = [words[i] for i in rng.integers(0, 500, rng.integers(4, 90))]
        for _ in range(rng.integers(1, 9)):
            texts.append(" ".join(w if rng.random() > rng.choice([0.0, 0.01, 0.03]) else words[rng.integers(0, 500)] for w in own))
    texts += [texts[0], texts[0], "", None, " ", "one two", "ONE  two", "one two three"]
    # Ids are repeated, by other texts and by the same.
    return [(int(i % 40) if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[10]), (3, texts[10])]


def _near_brute(rows, percent=80):
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    n = len(rows)
    linked = [[i != j and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    up = list(range(n))
    for _ in range(n):
        new = [min([up[i], *(up[j] for j in range(n) if linked[i][j])]) for i in range(n)]
        if new == up:
            break
        up = new
    return sets, linked, up


@pytest.mark.parametrize(("seed", "unit"), [(0, 2_000_000), (1, 300)])
def test_shingle_join_of_repeated_ids(spark, seed, unit, monkeypatch):
    from orrery.llm import shingle_join
    from orrery.llm.shingle_join import NO_ID, ShingleJoin

    monkeypatch.setattr(shingle_join, "UNIT_SHINGLES", unit)
    rows = _near_rows(np.random.default_rng(20 + seed))
    sets, linked, up = _near_brute(rows)
    least = {}
    for (i, _), c in zip(rows, up, strict=True):
        i = NO_ID if i is None else i
        least[c] = min(least.get(c, i), i)
    back = lambda i: None if i == NO_ID else i
    want = sorted(((rows[k][0], len(sets[k]), back(least[up[k]]), sum(linked[k])) for k in range(len(rows))), key=str)
    found = ShingleJoin(spark.createDataFrame(rows, "doc_id long, text string"), light=4).linked_documents().collect()
    assert sorted(((r.id, r.n_shingles, r.component_id, r.n_links) for r in found), key=str) == want
    assert len({r.component_key for r in found if r.n_shingles}) == len({c for c, s in zip(up, sets, strict=True) if s})


def _marked(spark, model, strings):
    from orrery.llm.secrets import scan_secrets

    df = spark.createDataFrame([(i, f"see {s} now") for i, s in enumerate(strings)], "doc_id long, text string")
    return {r.doc_id for r in scan_secrets(df, model=model).collect() if any(s["rank"] == 3 for s in r.spans)}


def test_secrets_names_from_outside_the_corpus_are_left(spark):
    """Identifiers of words that the corpus lacks are left, planted random strings are found."""
    from orrery.llm.secrets import fit_models

    model = fit_models(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = np.random.default_rng(31)
    stems = "kettle marble harbour thistle quiver bracket magnet furnace glacier walnut ribbon pepper violin orchard cobalt lantern meadow saddle turbine velvet whistle anchor beacon cradle dolphin ember falcon gravel hollow ivory jungle kernel ladder mirror nozzle oxygen pebble quartz rocket signal tunnel umbrella valley winter yonder zephyr".split()

    def name(k):
        w = [str(x) for x in rng.choice(stems, rng.integers(2, 5))]
        return [w[0] + "".join(map(str.title, w[1:])), "".join(map(str.title, w)), "_".join(w), "/".join(w), "-".join(w) + f"-v{rng.integers(1, 20)}", "_".join(w).upper()][k % 6]

    names = [name(k) for k in range(1200)]
    false = _marked(spark, model, names)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    found = {n: len(_marked(spark, model, ["".join(rng.choice(letters, n)) for _ in range(300)])) / 300 for n in (12, 16, 24)}
    print("false alarms", len(false) / len(names), [names[i] for i in sorted(false)][:5], "found", found)
    assert len(false) <= 0.01 * len(names)
    assert found[12] >= 0.8 and found[16] >= 0.94 and found[24] >= 0.98


def test_secrets_text_with_very_many_spans(spark):
    """Base spans and runs between them, more than a block of the sweep: as if each were a text of its own."""
    from orrery.llm.secrets import base_and_runs

    parts = [f"token=abcdEFGH{i} xrun{i}word{'z' * (i % 5)} AKIA{'A' * 13}{i}/leftover{i}rest " for i in range(900)]
    df = spark.createDataFrame([(-1, "".join(parts))] + list(enumerate(parts)), "doc_id long, text string")
    rows = {r.id: r for r in base_and_runs(df, "text", "doc_id", 8).collect()}
    at, base, runs = 0, [], []
    for i, part in enumerate(parts):
        for held, own in ((base, rows[i].base), (runs, rows[i].runs)):
            held += [(s.start + at, s.rank, s.end + at, s.value) for s in own]
        at += len(part)
    assert [tuple(s) for s in rows[-1].base] == base and [tuple(s) for s in rows[-1].runs] == runs and len(runs) >= 1800
