"""The octree: against a plain recursive one, against direct sums, and cut into domains."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import orrery as o
from orrery.operators.domains import Domains, needed, settle, summary, walk
from orrery.operators.tree import CLOSED, DEPTH, INNER, LEAF, Tree, codes, cube_of, indices, monomials, moved, pair_sums


def cloud(n=900, seed=0):
    rng = np.random.default_rng(seed)
    pos = np.concatenate([rng.normal(size=(n // 2, 3)), 0.01 * rng.normal(size=(n // 3, 3)) + 1, np.full((n - n // 2 - n // 3, 3), 2.0)])
    return pos, rng.uniform(0.5, 1.5, n), rng.uniform(0, 0.2, n)


def plain_leaves(pos, capacity):
    """Leaves by cutting cubes one after the other."""
    out, todo = set(), [(np.arange(len(pos)), *cube_of(pos), 0)]
    while todo:
        own, centre, half, depth = todo.pop()
        if len(own) <= capacity or depth >= DEPTH:
            out.add((frozenset(own.tolist()), depth))
            continue
        octant = (pos[own] >= centre) @ np.array([1, 2, 4])
        todo += [(own[octant == k], centre + np.where([k & 1, k & 2, k & 4], 0.5, -0.5) * half, 0.5 * half, depth + 1) for k in np.unique(octant)]
    return out


def leaves(tree, root_half):
    return {(frozenset(tree.ids[tree.start[i] : tree.end[i]].tolist()), round(np.log2(root_half / tree.half[i]))) for i in np.flatnonzero(tree.kind == LEAF)}


@pytest.mark.parametrize("capacity", [1, 8, 50])
def test_leaves_are_those_of_cubes(capacity):
    pos, m, h = cloud()
    tree = Tree.build(pos, m, h, np.arange(len(pos)), leaf_capacity=capacity)
    assert leaves(tree, cube_of(pos)[1]) == plain_leaves(pos, capacity)
    assert (np.diff(tree.parent) >= 0).all() and tree.levels[-1] == len(tree.start)


@pytest.mark.parametrize("order", range(6))
def test_moments_moved_upwards_are_direct_sums(order):
    pos, m, h = cloud()
    tree = Tree.build(pos, m, h, np.arange(len(pos)), order=order, leaf_capacity=4)
    under = {i: set() for i in range(len(tree.start))}
    for i in np.flatnonzero(tree.kids == 0):
        at = i
        while at >= 0:
            under[at] |= set(range(tree.start[i], tree.end[i]))
            at = tree.parent[at]
    for node, rows in under.items():
        own = sorted(rows)
        mass, x = tree.mass[own], tree.pos[own]
        assert tree.total[node] == pytest.approx(mass.sum(), rel=1e-12, abs=1e-12) and tree.hmax[node] == tree.soft[own].max()
        assert np.allclose(tree.com[node], (mass[:, None] * x).sum(0) / mass.sum(), rtol=1e-12, atol=1e-12)
        terms = mass[:, None] * monomials(x - tree.com[node], order if order > 1 else 0)
        assert (np.abs(tree.moments[node] - terms.sum(0)) <= 1e-12 * (np.abs(terms).sum(0) + mass.sum())).all()


def test_moving_there_and_back():
    rng = np.random.default_rng(1)
    m, s = rng.normal(size=(5, len(indices(5)))), rng.normal(size=(5, 3))
    assert np.allclose(moved(moved(m, s, 5), -s, 5), m, atol=1e-10) and np.allclose(moved(m, 0 * s, 5), m)


@pytest.mark.parametrize("own", [True, False])
def test_essential_part_gives_the_same_sums(own):
    pos, m, h = cloud()
    tree = Tree.build(pos, m, h, np.arange(len(pos)), kernel="plummer")
    box = (pos > 0.9).all(1) & (pos < 1.1).all(1)
    low, high = pos[box].min(0), pos[box].max(0)
    part = tree.essential(low, high, h[box].max(), 0.7, own)
    assert len(part.start) < len(tree.start) and (part.kind == CLOSED).any() and set(part.ids) < set(tree.ids)
    ids = np.flatnonzero(box) if own else None
    for x, y in zip(tree.evaluate(pos[box], 0.7, ids, h[box]), part.evaluate(pos[box], 0.7, ids, h[box]), strict=True):
        assert np.allclose(x, y, rtol=1e-12)
    with pytest.raises(AssertionError, match="closed"):
        part.evaluate(pos, 0.7, np.arange(len(pos)) if own else None, h)


def test_domains_hold_few_and_the_tree_above_is_theirs():
    pos, m, h = cloud()
    cube = cube_of(pos)
    found, big, top, code = [], None, 0, codes(pos, *cube)
    for depth in (2, 4, DEPTH):
        at, n = np.unique(code >> 3 * (DEPTH - depth), return_counts=True)
        if big is not None:
            keep = np.isin(at >> 3 * (depth - top), big)
            at, n = at[keep], n[keep]
        more, big = settle(dict(zip(at.tolist(), n.tolist(), strict=True)), depth, top, 50)
        found, top = found + more, depth
    domains = Domains.of(cube, found + [(DEPTH, c) for c in big])
    of = domains.of_points(pos)
    held = np.bincount(of, minlength=len(domains.start))
    assert held.sum() == 900 and (held > 0).all() and sorted(held)[-1] == 150 and sorted(held)[-2] <= 50
    whole = Tree.build(pos, m, h, np.arange(900), kernel="spline")
    trees = [Tree.build(pos[of == i], m[of == i], h[of == i], np.flatnonzero(of == i), cube=cube, depth=int(domains.depth[i]), kernel="spline") for i in range(len(held))]
    assert set().union(*(leaves(t, cube[1]) for t in trees)) == leaves(whole, cube[1])
    above, domain = domains.top([summary(t) for t in trees], 3, "spline", True)
    assert np.allclose(above.moments[0], whole.moments[0], rtol=1e-9, atol=1e-9) and np.allclose(above.com[0], whole.com[0])
    assert sorted(domain[domain >= 0]) == list(range(len(held))) and (above.kids[domain >= 0] == 0).all() and (above.kind[domain < 0] == INNER).all()
    for theta in (0.0, 0.7, 1.5):
        near = pos[:40]
        asked = needed(above, domain, near.min(0), near.max(0), h[:40].max(), theta, True)
        assert len(set(asked)) == len(asked) and (theta or len(asked) == len(held))
        parts = {i: trees[i].essential(near.min(0), near.max(0), h[:40].max(), theta, True) for i in asked}
        for x, y in zip(walk(above, domain, parts, near, theta, np.arange(40), h[:40]), whole.evaluate(near, theta, np.arange(40), h[:40]), strict=True):
            assert np.allclose(x, y, rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("cell", [10_000, 90])
def test_spark_tree_is_the_same_tree(spark, cell):
    pos, m, h = cloud(600, 3)
    s = o.from_arrays(spark, {"pos": pos, "mass": m, "eps": h})
    tree = Tree.build(pos, m, h, np.arange(600), order=4, kernel="plummer")
    phi, acc = tree.evaluate(pos, 0.6, np.arange(600), h)
    g = o.Gravity(s, "eps", "plummer", theta=0.6, multipole_order=4, cell=cell)
    got = g.tree().orderBy("pid").toPandas()
    assert np.allclose(got["phi"], phi, rtol=1e-11) and np.allclose(got[["ax", "ay", "az"]], acc, rtol=1e-9, atol=1e-7)
    points = spark.createDataFrame([(i, 9.0 * i - 20, 0.3, float(i)) for i in range(7)], "pid long, x double, y double, z double")
    at = np.array([(9.0 * i - 20, 0.3, float(i)) for i in range(7)])
    forest = g.forest
    assert np.allclose(g.tree(points).orderBy("pid").toPandas()["phi"], tree.evaluate(at, 0.6)[0], rtol=1e-11)
    assert g.forest is forest and forest.n == 600 and (len(forest.domains.start) > 5) == (cell == 90)
    forest.trees.unpersist()


def test_what_is_sent_is_little(spark):
    """Every particle is sent to its own block and, where needed, to near ones; not to all."""
    df = spark.range(20_000).select(F.col("id").alias("pid"), *[F.rand(i + 1).alias(c) for i, c in enumerate("xyz")], F.lit(1.0).alias("mass"))
    g = o.Gravity(o.Snapshot(df.withColumn("x", F.col("x") * 40)), cell=400)
    _, sent, _ = g._exchange(None)
    blocks, domains = sent.select(F.countDistinct("block"), F.countDistinct("domain")).first()
    assert domains > 60 and sent.count() < 0.3 * blocks * domains and sent.agg(F.sum(F.length("part"))).first()[0] < 8 * g.forest.trees.agg(F.sum(F.length("tree"))).first()[0]
    g.forest.trees.unpersist()


def test_odd_inputs(spark):
    s = o.from_arrays(spark, {"pos": np.zeros((30, 3)), "mass": np.ones(30)})
    g = o.Gravity(s, 0.1, "spline", cell=8)
    assert np.isfinite(g.tree().toPandas().to_numpy()).all()
    one = o.Gravity(o.from_arrays(spark, {"pos": np.ones((1, 3)), "mass": np.ones(1)})).tree().first()
    assert one.phi == 0 and one.ax == 0
    with pytest.raises(ValueError, match="no particles"):
        o.Gravity(s.where(F.lit(False))).tree()
    with pytest.raises(ValueError, match="numbers"):
        o.Gravity(o.from_arrays(spark, {"pos": np.full((2, 3), np.nan), "mass": np.ones(2)})).tree()
    massless = o.from_arrays(spark, {"pos": np.eye(3), "mass": np.zeros(3)})
    assert o.Gravity(massless).tree().agg(F.max(F.abs("phi"))).first()[0] == 0
    p, a = pair_sums(np.eye(3), np.zeros(3), np.eye(3), np.zeros(3), np.zeros(3), "newton", False, True, np.arange(3), np.arange(3))
    assert not p.any() and not a.any()


def test_many_small_domains_share_blocks_and_come_in_slices(spark, monkeypatch):
    """At theta 0 every particle meets every other: few blocks, whole domains as rows, no task with all of them."""
    from orrery.operators import gravity

    monkeypatch.setattr(gravity, "SLICE", 200)
    pos, m, h = cloud(700, 5)
    s = o.from_arrays(spark, {"pos": pos, "mass": m, "eps": h})
    for theta in (0.0, 0.6):
        g = o.Gravity(s, "eps", "plummer", theta=theta, cell=20)
        placed, sent, _ = g._exchange(None)
        assert g.forest.slices > 2 and placed.select("block").distinct().count() < len(g.forest.domains.start) / 2
        assert theta or sent.agg(F.bool_and("whole")).first()[0]
        phi, acc = Tree.build(pos, m, h, np.arange(700), kernel="plummer").evaluate(pos, theta, np.arange(700), h)
        got = g.tree().orderBy("pid").toPandas()
        assert np.allclose(got["phi"], phi, rtol=1e-11) and np.allclose(got[["ax", "ay", "az"]], acc, rtol=1e-9, atol=1e-7)
        assert g.tree(sums=("phi",)).columns == ["pid", "phi"]
        g.release()


def test_walk_holds_few_pairs(monkeypatch):
    """Pairs of target and node are met some at a time; the sums are the same."""
    from orrery.operators import tree as t

    pos, m, h = cloud(1500, 7)
    whole = Tree.build(pos, m, h, np.arange(1500), kernel="spline")
    want = whole.evaluate(pos, 0.7, np.arange(1500), h)
    monkeypatch.setattr(t, "PAIRS", 100)
    held = []
    far = Tree.far
    monkeypatch.setattr(Tree, "far", lambda self, targets, a, *rest: held.append(len(a)) or far(self, targets, a, *rest))
    for x, y in zip(whole.evaluate(pos, 0.7, np.arange(1500), h), want, strict=True):
        assert np.allclose(x, y, rtol=1e-10, atol=1e-8)
    assert max(held) <= 100
    held.clear()
    assert np.allclose(whole.evaluate(pos, 0.0, np.arange(1500), h)[0], pair_sums(pos, h, pos, m, h, "spline", True, True, np.arange(1500), np.arange(1500))[0], rtol=1e-11)
    assert not held


def test_acceleration_is_the_gradient_of_the_potential():
    pos, m, _ = cloud()
    for order in (0, 3, 4, 5):
        tree = Tree.build(pos, m, None, np.arange(900), order=order)
        at, step = np.array([[9.0, 7.0, -8.0]]), 1e-4
        slope = [(tree.evaluate(at + e, 0.9)[0] - tree.evaluate(at - e, 0.9)[0])[0] / (2 * step) for e in step * np.eye(3)]
        assert np.allclose(tree.evaluate(at, 0.9)[1][0], -np.array(slope), rtol=1e-7)


@pytest.mark.parametrize("kind", ["newton", "plummer", "spline"])
@pytest.mark.parametrize("where", [0.0, 1e5])
def test_tiles_give_near_pairs_one_by_one(kind, where):
    """Products of places cancel for pairs that are close for their tile: those come apart, with the factors of their own separations."""
    from orrery.operators.tree import Meeting, kernel_values, own_sums

    rng = np.random.default_rng(4)
    pos = np.concatenate([rng.normal(size=(1000, 3)), 1e-4 * rng.normal(size=(150, 3)) + 2, np.repeat(rng.normal(size=(50, 3)), 4, 0)]) + where
    m, h, ids = rng.uniform(1, 2, len(pos)), rng.choice([0.05, 0.7], len(pos)), np.arange(len(pos))
    if kind == "spline":
        h[:5] = 0.0
    d = pos[None] - pos[:, None]
    p, g = kernel_values(kind, (d * d).sum(2).ravel(), np.maximum(h[:, None], h[None]).ravel() if kind != "newton" else 0.0)
    p, g = (x.reshape(len(pos), -1) * (1 - np.eye(len(pos))) for x in (p, g))
    phi, acc = -(p @ m), np.einsum("ij,ijk->ik", g * m, d)
    size = np.einsum("ij,ijk->ik", g * m, np.abs(d)).max(1)
    soft = kind != "newton"
    for got in (pair_sums(pos, h, pos, m, h, kind, soft, True, ids, ids), own_sums(pos, h, m, ids, kind, soft, block=300)):
        assert np.allclose(got[0], phi, rtol=1e-12) and (np.abs(got[1] - acc).max(1) <= 1e-12 * size).all()
    near = [t[-1] for t in Meeting(kind, soft, True, True).tiles(pos, h, pos, h, (ids, ids))]
    assert 150**2 <= sum(len(x[0]) for x in near if x is not None) < len(pos) ** 2 / 4


def test_direct_pairs_are_many_for_the_cores(spark, monkeypatch):
    from orrery.operators import gravity

    dealt, paired = [], gravity._paired
    monkeypatch.setattr(gravity, "_paired", lambda particles, n: dealt.append(n) or paired(particles, n))
    monkeypatch.setattr(gravity, "BROADCAST_SOURCES", 10)
    pos, m, _ = cloud(60)
    o.Gravity(o.from_arrays(spark, {"pos": pos, "mass": m})).direct()
    n = dealt[0]
    assert n * (n + 1) // 2 >= 16 * spark.sparkContext.defaultParallelism


def test_domains_are_built_in_bundles_and_sent_once(spark, monkeypatch):
    """Many small domains are few groups, slices are even, and the choice of slices does not need what is sent."""
    from orrery.operators import gravity

    monkeypatch.setattr(gravity, "SLICE", 400)
    pos, m, h = cloud(500, 6)
    g = o.Gravity(o.from_arrays(spark, {"pos": pos, "mass": m, "eps": h}), "eps", "plummer", theta=0.0, cell=4)
    out = g.tree(sums=("phi",))
    domains, held = len(g.forest.domains.start), np.array([g.forest.held[i] for i in range(len(g.forest.held))])
    assert domains > 100 and g.forest.trees.select("bundle").distinct().count() == g.forest.bundles <= 4 * spark.sparkContext.defaultParallelism
    assert g.forest.slices == 2 and np.bincount(g.forest.slice_of, held).min() > 200
    want = Tree.build(pos, m, h, np.arange(500), kernel="plummer").evaluate(pos, 0.0, np.arange(500), h)[0]
    assert np.allclose(out.orderBy("pid").toPandas()["phi"], want, rtol=1e-11)
    # One exchange of what is sent: its plan holds the call that makes it once.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 2
    g.release()


@pytest.mark.parametrize("order", [0, 3, 5])
def test_targets_whose_pulls_cancel_walk_again(spark, order):
    """In the middle of a cloud next to nothing is left of the pulls: the error goes with what is left, not with them."""
    rng = np.random.default_rng(8)
    pos, none = 3 * rng.normal(size=(1500, 3)), np.zeros(1500)
    s = o.from_arrays(spark, {"pos": pos, "mass": np.ones(1500)})
    pulls = lambda x: pair_sums(x, none[: len(x)], pos, np.ones(1500), none, "newton", False, False)[1]
    middle = np.zeros((1, 3))
    for _ in range(60):  # Newton's steps, held short, to where nothing is left
        slope = np.stack([(pulls(middle + e) - pulls(middle - e))[0] / 2e-5 for e in 1e-5 * np.eye(3)], 1)
        step = -np.linalg.solve(slope, pulls(middle)[0])
        middle = middle + step * min(1.0, 0.05 / np.linalg.norm(step))
    at = np.concatenate([middle + 1e-4 * rng.normal(size=(6, 3)), 3.0 * rng.normal(size=(6, 3)), middle])
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "pid long, x double, y double, z double")
    g = o.Gravity(s, theta=0.9, multipole_order=order, cell=100)
    got, want = (f(points).orderBy("pid").toPandas() for f in (g.tree, g.direct))
    assert got["pid"].tolist() == list(range(13)) and got.columns.tolist() == ["pid", "phi", "ax", "ay", "az"]
    a, b = (x[["ax", "ay", "az"]].to_numpy() for x in (got, want))
    size = np.sqrt((b * b).sum(1))
    assert size[:6].max() < 0.01 * size[6:12].min()
    assert (np.sqrt(((a - b) ** 2).sum(1)) <= {0: 0.2, 3: 0.05, 5: 0.02}[order] * size + 1e-9).all()
    assert g.tree(points, ("ay",)).columns == ["pid", "ay"]
    g.release()
