"""Vector codes against plain integers, and odd rows."""

import numpy as np
import pytest

from orrery.llm.vector_codes import VectorCodes, assign, nearest, with_label_error


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes, errors and codebooks by Python integers."""
    width = -(-max((len(v) for _, v in rows), default=0) // parts)
    xs = [[*(int(np.floor(float(c) * scale)) for c in v), *[0] * (width * parts - len(v))] for _, v in rows]
    part = lambda x, p: x[p * width : (p + 1) * width]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))[:entries]
    books = [[part(xs[i], p) for i in first] for p in range(parts)]

    def coded(x):
        near = [min((sum((a - b) ** 2 for a, b in zip(part(x, p), c, strict=True)), k) for k, c in enumerate(books[p])) for p in range(parts)]
        return [k for _, k in near], sum(e for e, _ in near)

    for _ in range(rounds):
        codes = [coded(x)[0] for x in xs]
        books = [[[sum(col) // len(col) for col in zip(*own, strict=True)] if (own := [part(x, p) for x, c in zip(xs, codes, strict=True) if c[p] == k]) else old for k, old in enumerate(books[p])] for p in range(parts)]
    return [coded(x) for x in xs], books


@pytest.mark.parametrize("high", [3, 40, 5000, 2**20, 2**24])
@pytest.mark.parametrize("d", [1, 8, 200])
def test_nearest_is_exact(high, d):
    """Close and equal distances: many entries fall within the intervals."""
    rng = np.random.default_rng(high + d)
    c = rng.integers(-high, high + 1, (16, d))
    c[7] = c[2]
    c[9] = c[3] + (np.arange(d) == 0)
    c = np.clip(c, -high, high)
    x = np.clip(np.concatenate([c, c + rng.integers(-1, 2, c.shape), (c[:1] + c) // 2, rng.integers(-high, high + 1, (300, d))]), -high, high)
    far = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (nearest(x, c) == far.argmin(1)).all()


def test_against_plain_integers(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 16))
    rows = [(int(i), [float(np.float32(c)) for c in centres[i % 5] + rng.normal(size=16) * 0.05], int(i % 3) if i % 7 else None) for i in rng.permutation(300)]
    rows += [(400 + i, rows[0][1], 1) for i in range(40)] + [(500, [0.0] * 16, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    model = VectorCodes(df, label_col="label")
    want, books = plain([r[:2] for r in rows])
    assert model.books.tolist() == books
    got = {r.id: r for r in with_label_error(model.encode()).collect()}
    sums = {}
    for r, (_, e) in zip(rows, want, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    assert len(got) == len(rows)
    for r, (codes, error) in zip(rows, want, strict=True):
        assert (got[r[0]].code, got[r[0]].error, got[r[0]].label_error) == (bytes(codes).hex(), error, sums[r[2]])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [nan] * 9), (3, [1.0, None]), (4, [inf, 1.0]), (5, []), (None, [1.0, -2.0, 3.5]), (7, [0.1 * i for i in range(9)]), (7, [0.1 * i for i in range(9)]), (8, [1e30] * 9), (6, [0.0] * 9)]
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "vec_id int, embedding array<double>, id string, n int")
    out = with_label_error(VectorCodes(df).encode()).collect()
    assert sorted((r.id is None, r.id or 0) for r in out) == [(False, 5), (False, 6), (False, 7), (False, 7), (False, 8), (True, 0)]
    assert all(len(r.code) == 16 and r.label_error == sum(o.error for o in out) for r in out)
    assert len({r.code for r in out if r.id == 7}) == 1
    empty = VectorCodes(df.limit(0))
    assert with_label_error(empty.encode()).count() == 0 and len(empty.digest()) == 64
    only_empty = VectorCodes(spark.createDataFrame([(1, [])], "vec_id int, embedding array<float>"))
    assert [r.error for r in only_empty.encode().collect()] == [0]
    assert VectorCodes(df.where("vec_id = 1")).encode().count() == 0


def test_rare_labels_are_joined_by_shuffle(spark, monkeypatch):
    import orrery.llm.vector_codes as v

    rows = spark.createDataFrame([(i, (i % 40 if i % 2 else 0) if i % 5 else None, "00", i) for i in range(400)], "id long, label long, code string, error long")
    want = sorted(map(tuple, with_label_error(rows).collect()))
    monkeypatch.setattr(v, "LABELS", 4)
    assert sorted(map(tuple, with_label_error(rows).collect())) == want and len(want) == 400


def test_assign_adds_parts():
    books = np.array([[[0], [10]], [[0], [10]]])
    codes, error = assign(np.array([[1, 9], [5, 5]]), books)
    assert codes.tolist() == [[0, 1], [0, 0]] and error.tolist() == [2, 50]
