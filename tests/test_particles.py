"""Laws, and numpy as the oracle, on small snapshots."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import orrery as o
from orrery.functions import clip, divide
from orrery.operators.bins import as_edges
from orrery.operators.properties import ShrinkingSphere
from orrery.operators.transforms import face_on
from orrery.operators.tree import Tree, indices
from orrery.plans import CycleError
from orrery.streaming import running
from orrery.units import Unit, in_units


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(7)
    n = 300
    return {"pos": rng.normal(size=(n, 3)) * 3, "vel": rng.normal(size=(n, 3)), "mass": rng.integers(8, 25, n) / 16, "phi": rng.normal(size=n), "family": np.array(["dm", "gas", "star"])[rng.integers(0, 3, n)]}


@pytest.fixture(scope="module")
def snap(spark, arrays):
    data = {k: v for k, v in arrays.items() if k != "family"}
    return o.from_arrays(spark, data, family=arrays["family"], units={"pos": "kpc", "vel": "km s^-1", "mass": "Msol"}, boxsize=4.0)


def test_units():
    assert in_units("30 kpc", "pc") == pytest.approx(30_000) and in_units(3, "kpc") == 3.0
    assert Unit.parse("km s^-1").ratio("kpc Gyr^-1") == pytest.approx(1.0227, rel=1e-3)
    assert Unit.parse("Msol / kpc**3").dims == (Unit.parse("Msol") / Unit.parse("kpc") ** 3).dims
    with pytest.raises(ValueError):
        in_units("3 s", "kpc")


def test_arithmetic(spark):
    row = spark.sql("SELECT 1D AS a, 0D AS z, double('NaN') AS n").select(divide(F.col("a"), F.col("z")), divide(-F.col("a"), F.col("z")), divide(F.col("z"), F.col("z")), clip(F.col("n"), F.lit(0.0), F.lit(1.0)), clip(F.lit(5.0), None, F.lit(1.0))).first()
    assert row[0] == math.inf and row[1] == -math.inf and math.isnan(row[2]) and math.isnan(row[3]) and row[4] == 1.0


def test_filter_algebra(snap, arrays):
    r = np.linalg.norm(arrays["pos"], axis=1)
    f, g = o.Sphere("3 kpc"), o.FamilyFilter("star")
    count = lambda x: o.Count().filter(x)(snap)
    a, b = r < 3, arrays["family"] == "star"
    assert (count(f & g), count(f | g), count(~f)) == ((a & b).sum(), (a | b).sum(), (~a).sum())
    with pytest.raises(TypeError):
        f ^ g
    with pytest.raises(ValueError):
        o.FamilyFilter("planet")
    assert o.Cuboid(-1.0).volume(snap) == 8.0 and o.Sphere("1000 pc").volume(snap) == pytest.approx(4 / 3 * math.pi)


def test_nan_is_in_no_band(spark):
    s = o.Snapshot(spark.sql("SELECT 0L AS pid, 'gas' AS family, double('NaN') AS temp"))
    assert [o.Count().filter(f)(s) for f in (o.HighPass("temp", 1.0), o.LowPass("temp", 1.0), o.BandPass("temp", 0, 2), ~o.LowPass("temp", 1.0))] == [0, 0, 0, 1]


def _contain(key, w, p):
    i = np.lexsort((w, key))
    c = np.cumsum(w[i])
    return np.interp(p, (c - c[0]) / (c[-1] - c[0]), key[i])


def test_contain(snap, arrays):
    r = np.linalg.norm(arrays["pos"], axis=1)
    assert o.ParamContain("r", 0.5, "mass")(snap) == pytest.approx(_contain(r, arrays["mass"], 0.5))
    assert o.ParamContain("r", [0.2, 0.8])(snap) == pytest.approx(_contain(r, arrays["mass"], [0.2, 0.8]))
    with pytest.raises(ValueError):
        o.ParamContain("r", 1.5)


def test_pipeline_is_one_aggregate(snap):
    p = o.Pipeline({"m": o.ParamSum(), "l": o.AngMomVec(), "k": o.KappaRot()})
    plan = p.frame(snap)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and set(p(snap)) == {"m", "l", "k"}
    with pytest.raises(ValueError):
        o.Pipeline({})


def test_errors(snap):
    bad = o.Pipeline({"m": o.ParamSum(), "x": o.ParamSum("nothing").filter(o.Sphere(1.0))})
    with pytest.raises(KeyError):
        bad.run(snap)
    out = bad.run(snap, o.RunOptions(errors="collect_partial"))
    assert out.value["x"] is None and out.value["m"] > 0 and not out.ok and "failed" in out.tree()


def test_scope_order(snap, arrays):
    """Transforms come before filters of the same scope, and move all particles."""
    pos, m = arrays["pos"], arrays["mass"]
    com = (pos * m[:, None]).sum(0) / m.sum()
    inside = np.linalg.norm(pos - com, axis=1) < 2
    assert o.ParamSum().filter(o.Sphere(2.0)).transform(o.ShiftPosTo("com"))(snap) == pytest.approx(m[inside].sum())
    star = arrays["family"] == "star"
    sc = (pos[star] * m[star, None]).sum(0) / m[star].sum()
    assert o.CenPos("com").transform(o.ShiftPosTo("com").measure_with(o.FamilyFilter("star")))(snap) == pytest.approx(tuple(com - sc))
    outer = o.ParamSum().transform(o.ShiftPosTo("com")).filter(o.Sphere(2.0))
    nested = o.Bound(o.ParamSum().transform(o.ShiftPosTo("com")), o.Scope(filters=(o.FamilyFilter("star"),)))
    assert outer(snap) == pytest.approx(m[inside].sum()) and nested(snap) == pytest.approx(m[star].sum())


def test_dynamic_parameter_is_one_plan(snap, arrays):
    r, m = np.linalg.norm(arrays["pos"], axis=1), arrays["mass"]
    calc = o.ParamSum().filter(o.Sphere(o.ParamContain("r", 0.5)))
    assert "scalar-subquery" in calc.frame(snap)._jdf.queryExecution().optimizedPlan().toString()
    assert calc(snap) == pytest.approx(m[r < _contain(r, m, 0.5)].sum())


def test_cycle():
    a = o.Pipeline({"m": o.ParamSum()})
    a.parts["self"] = a
    with pytest.raises(CycleError):
        a.check()


def test_rotation_keeps_lengths(snap, arrays):
    turned = o.AlignVec(o.AngMomVec()).apply(snap)
    j = np.array(o.AngMomVec()(turned))
    assert abs(j[:2]).max() < 1e-9 and j[2] == pytest.approx(np.linalg.norm(np.cross(arrays["pos"], arrays["vel"]).T @ arrays["mass"]))
    assert o.ParamSum("r")(turned) == pytest.approx(o.ParamSum("r")(snap))
    for v in ([0, 1, 0], [1, 2, 3], [0, 0, -1]):
        m = face_on(v)
        assert m @ m.T == pytest.approx(np.eye(3)) and np.linalg.det(m) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        face_on([0, 0, 0])


def test_wrap(spark, snap):
    pair = o.from_arrays(spark, {"pos": np.array([[1.0, 0, 0], [9.0, 0, 0]]), "mass": np.ones(2)}, boxsize=10.0)
    x = lambda t: sorted(r.x for r in t.apply(pair).df.collect())
    assert x(o.WrapBox(convention="center")) == [-1, 1] and x(o.WrapBox(convention="upper")) == [1, 9] and x(o.WrapBox()) == [-1, 1]
    once = o.WrapBox(convention="center").apply(snap)
    assert o.ParamSum("r")(o.WrapBox(convention="center").apply(once)) == pytest.approx(o.ParamSum("r")(once))
    with pytest.warns(UserWarning):
        o.WrapBox().apply(o.Snapshot(snap.df))


def test_edges_and_ties(spark):
    s = o.Snapshot(spark.sql("SELECT id AS pid, 'dm' AS family, x FROM VALUES (0L, 1D), (1L, 2D), (2L, 2.5D), (3L, 3D), (4L, 0.5D), (5L, 9D), (6L, double('NaN')) AS t(id, x)"))
    e = as_edges((1, 2, 2, 3))(s)
    assert [r[0] for r in s.df.orderBy("pid").select(e.assign(F.col("x"))).collect()] == [0, 0, 2, 2, None, None, None]


@pytest.mark.parametrize("nbins", [1, 7, 100])
def test_even_bins_agree_with_the_table(spark, nbins):
    rng = np.random.default_rng(nbins)
    e = o.Edges(np.linspace(0.1, 7.7, nbins + 1), np.ones(nbins), True)
    x = np.concatenate([rng.uniform(-1, 9, 500), e.edges, np.nextafter(e.edges, 9), np.nextafter(e.edges, -9)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    other = o.Edges(e.edges, e.size, False)
    assert df.where(~e.assign(F.col("x")).eqNullSafe(other.assign(F.col("x")))).count() == 0


def test_profile(snap, arrays):
    r, m = np.linalg.norm(arrays["pos"], axis=1), arrays["mass"]
    pr = o.RadialProfile(snap, weight="mass", nbins=5)
    assert pr["mass"]["med"] == pytest.approx(pr["mass"]["p50"])
    assert (pr.s.npart_bins + pr.g.npart_bins + pr.dm.npart_bins == pr.npart_bins).all() and pr.npart_bins.sum() == len(r)
    edges = np.linspace(r.min(), r.max(), 6)
    at = np.clip(np.searchsorted(edges, r, side="left") - 1, 0, 4)
    assert pr["r"]["p16"] == pytest.approx([_contain(r[at == i], m[at == i], 0.16) for i in range(5)])
    assert pr["vr_disp"][0] == pytest.approx(pr["vr"]["disp"][0]) and len(pr["mass_enc"]) == 5
    assert pr["mass_enc"][4] == pytest.approx(m.sum())
    with pytest.raises(ValueError):
        pr["mass"]["p101"]
    with pytest.raises(RuntimeError):
        pr["density"]["mean"]


def test_empty_and_single_bins(spark):
    s = o.from_arrays(spark, {"pos": np.array([[0.0, 0, 0], [1.0, 0, 0], [10.0, 0, 0]]), "mass": np.ones(3)})
    pr = o.RadialProfile(s, weight="mass", nbins=5)
    assert pr.npart_bins.tolist() == [2, 0, 0, 0, 1] and np.isnan(pr["mass"]["sum"][1:4]).all() and np.isnan(pr["mass_enc"][1:]).all()
    assert pr["r"]["p50"][4] == 10.0
    with pytest.raises(ValueError):
        o.StarAgeProfile(s)


def test_equaln_edges(snap, arrays):
    r = np.sort(np.linalg.norm(arrays["pos"], axis=1))
    e = o.BinsSet(bins_type="equaln", nbins=7)(snap)
    assert e.edges == pytest.approx([r[0], *(r[i * 300 // 7] for i in range(1, 7)), r[-1]])


def _direct(pos, m, eps=0.0):
    d = pos[None] - pos[:, None]
    r2 = (d * d).sum(-1) + eps * eps
    np.fill_diagonal(r2, np.inf)
    return -(m / np.sqrt(r2)).sum(1), (m[None, :, None] * d / r2[..., None] ** 1.5).sum(1)


def test_gravity(snap, arrays):
    s = o.Snapshot(snap.df)
    phi, acc = _direct(arrays["pos"], arrays["mass"])
    for got in (o.Gravity(s).direct(), o.Gravity(s, theta=0.0).tree()):
        rows = got.orderBy("pid").toPandas()
        assert rows.phi.to_numpy() == pytest.approx(phi) and rows[["ax", "ay", "az"]].to_numpy() == pytest.approx(acc)
    soft, _ = _direct(arrays["pos"], arrays["mass"], 0.3)
    assert o.calculate_potential(s, softening=0.3, kernel="plummer", method="direct").orderBy("pid").toPandas().phi.to_numpy() == pytest.approx(soft)
    with pytest.raises(ValueError):
        o.Gravity(s, softening=0.1)


def test_blocks_equal_broadcast(snap, monkeypatch):
    from orrery.operators import gravity as g

    s = o.Snapshot(snap.df)
    want = o.Gravity(s, 0.5, "spline").direct().orderBy("pid").toPandas()
    monkeypatch.setattr(g, "BROADCAST_SOURCES", 10)
    monkeypatch.setattr(g, "BLOCK", 70)
    got = o.Gravity(s, 0.5, "spline").direct().orderBy("pid").toPandas()
    assert got.to_numpy() == pytest.approx(want.to_numpy())


def test_each_pair_of_blocks_meets_once(snap, monkeypatch):
    from orrery.operators import gravity as g

    monkeypatch.setattr(g, "BROADCAST_SOURCES", 10)
    sources = o.Gravity(o.Snapshot(snap.df), 0.5, "spline").sources()
    pairs = g._paired(sources, 7)
    assert pairs.count() == 7 * sources.count()
    met = pairs.select("i", "j").distinct().collect()
    assert len(met) == 7 * 8 // 2 and all(r.i <= r.j for r in met)
    acted = []
    monkeypatch.setattr(g.Gravity, "_direct_mutual", lambda self, s: acted.append("mutual"))
    monkeypatch.setattr(g.Gravity, "_direct_blocks", lambda self, t, s: acted.append("points"))
    o.Gravity(o.Snapshot(snap.df)).direct()
    o.Gravity(o.Snapshot(snap.df)).direct(snap.df.select("pid", "x", "y", "z").limit(3))
    assert acted == ["mutual", "points"]


def test_mutual_sums_conserve_momentum_and_count_equal_ids_apart():
    from orrery.operators.tree import mutual_sums, own_sums, pair_sums

    rng = np.random.default_rng(8)
    a, h, m = rng.normal(size=(230, 3)), rng.uniform(0, 0.5, 230), rng.uniform(1, 2, 230)
    ids = np.arange(230) // 2  # rows of one id do not act on each other
    a[40] = a[7]
    for kind, soft in (("newton", False), ("plummer", True), ("spline", True)):
        want = pair_sums(a, h, a, m, h, kind, soft, True, ids, ids)
        phi, acc = own_sums(a, h, m, ids, kind, soft, block=60)
        assert phi == pytest.approx(want[0], rel=1e-10) and acc == pytest.approx(want[1], rel=1e-9, abs=1e-9)
        (p1, p2), (g1, g2) = mutual_sums(a[:90], h[:90], m[:90], a[90:], h[90:], m[90:], kind, soft, pairs=1000)
        assert p1 == pytest.approx(pair_sums(a[:90], h[:90], a[90:], m[90:], h[90:], kind, soft, True, ids[:90], -ids[90:] - 1)[0])
        assert m[:90] @ g1 + m[90:] @ g2 == pytest.approx(0, abs=1e-6) and len(p2) == 140
    assert mutual_sums(a, h, m, a[:0], h[:0], m[:0], "newton", False)[0][0].tolist() == [0.0] * 230


def test_two_bodies(spark):
    s = o.from_arrays(spark, {"pos": np.array([[0.0, 0, 0], [2.0, 0, 0]]), "mass": np.array([1.0, 3.0])})
    rows = o.Gravity(s).direct().orderBy("pid").collect()
    assert [r.phi for r in rows] == [-1.5, -0.5] and rows[0].ax == 0.75 and rows[1].ax == -0.25


def test_tree_error_falls_with_order():
    rng = np.random.default_rng(1)
    pos, m = rng.uniform(-0.5, 0.5, (600, 3)), rng.uniform(0.5, 1.5, 600)
    phi, acc = _direct(pos, m)
    errors, forces = [], []
    for order in (0, 2, 3, 4, 5):
        tree = Tree.build(pos, m, None, np.arange(600), order=order)
        p, a = tree.evaluate(pos, 0.7, np.arange(600))
        errors.append(np.abs(p / phi - 1).mean())
        forces.append((np.linalg.norm(a - acc, axis=1) / np.linalg.norm(acc, axis=1)).mean())
    assert all(x > y for x, y in zip(errors, errors[1:], strict=False)) and errors[-1] < 1e-4
    assert forces[0] == pytest.approx(forces[1]) and forces[1] > forces[2] > forces[3] > forces[4]
    assert len(indices(5)) == 56


def test_coincident_particles_end():
    tree = Tree.build(np.zeros((40, 3)), np.ones(40), np.full(40, 0.1), np.arange(40), kernel="spline")
    p, a = tree.evaluate(np.zeros((40, 3)), 0.7, np.arange(40), np.full(40, 0.1))
    assert np.isfinite(p).all() and np.isfinite(a).all()


def test_shrinking_sphere_finds_the_clump(spark):
    rng = np.random.default_rng(4)
    pos = np.concatenate([rng.normal([5, 5, 5], 0.05, (400, 3)), rng.uniform(-10, 10, (300, 3))])
    s = o.from_arrays(spark, {"pos": pos, "mass": np.ones(700)})
    assert np.allclose(ShrinkingSphere()(s), 5, atol=0.1)


def _shrunk(pos, mass, r, at, factor=0.7, least=100):
    path = []
    while True:
        inside = ((pos - at) ** 2).sum(1) < r * r
        if inside.any():
            at = mass[inside] @ pos[inside] / mass[inside].sum()
        path.append((int(inside.sum()), at))
        if inside.sum() < least:
            return at, len(path)
        r *= factor


@pytest.mark.parametrize("shape", ["clump", "even", "two"])
def test_shrinking_sphere_foretells_steps_and_does_them_exactly(spark, monkeypatch, shape):
    from orrery.operators import properties as p

    rng, n = np.random.default_rng(6), 60_000
    if shape == "clump":
        pos = np.concatenate([rng.normal(0, 1, (n // 2, 3)) * rng.uniform(0, 1, (n // 2, 1)) + [4, 1, 0], rng.uniform(-10, 10, (n // 2, 3))])
    elif shape == "even":
        pos = rng.uniform(-10, 10, (n, 3))
    else:
        pos = np.concatenate([rng.normal(0, 1, (n // 2, 3)) + 5, rng.normal(0, 0.8, (n - n // 2, 3)) - 5])
    mass = rng.uniform(0.5, 2, n)
    s = o.from_arrays(spark, {"pos": pos, "mass": mass})
    com = mass @ pos / mass.sum()
    want, steps = _shrunk(pos, mass, 0.7 * np.sqrt(((pos - com) ** 2).sum(1).max()), com)
    calls = {"one": 0, "several": 0, "near": 0}
    for name in calls:
        def count(self, *a, name=name, was=getattr(p.ShrinkingSphere, f"_{name}")):
            got = was(self, *a)
            calls[name] += got is not None
            return got

        monkeypatch.setattr(p.ShrinkingSphere, f"_{name}", count)
    assert ShrinkingSphere()(s) == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert calls["one"] == 0 and calls["several"] == 0 and calls["near"] <= 2 + steps // 2
    monkeypatch.setattr(p, "FEW", 4000)
    calls.update(one=0, several=0, near=0)
    assert ShrinkingSphere()(s) == pytest.approx(want, rel=1e-9, abs=1e-9)
    print(shape, steps, calls)
    assert calls["several"] >= 1
    monkeypatch.setattr(p, "FEW", 0)
    monkeypatch.setattr(p, "MANY", 0)
    calls.update(one=0, several=0, near=0)
    assert ShrinkingSphere()(s) == pytest.approx(want, rel=1e-9, abs=1e-9) and calls["one"] == steps


def test_shrinking_sphere_of_one_place_and_of_missing_values(spark):
    assert ShrinkingSphere()(o.from_arrays(spark, {"pos": np.full((150, 3), 2.0), "mass": np.ones(150)})) == pytest.approx((2, 2, 2))
    pos = np.random.default_rng(1).normal(3, 1, (500, 3))
    pos[::50] = np.nan
    s = o.from_arrays(spark, {"pos": pos, "mass": np.ones(500)})
    holes = s.df.replace(float("nan"), None)
    assert np.allclose(ShrinkingSphere()(o.Snapshot(holes)), 3, atol=0.5)


def test_write_read_and_prune(snap, tmp_path, spark):
    o.write_snapshot(snap, f"{tmp_path}/s")
    back = o.read_snapshot(spark, f"{tmp_path}/s")
    assert o.ParamSum()(back) == pytest.approx(o.ParamSum()(snap)) and back.units == snap.units and back.properties == {"boxsize": 4.0}
    plan = back.s.df.select("mass")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(family" in plan and "ReadSchema: struct<mass:double>" in plan


def test_selection_and_units(snap):
    assert snap.select(slice(10, 20)).df.count() == 10 and snap.select("star").df.count() == snap.s.df.count()
    m = snap.physical_units(distance="pc")
    assert o.ParamSum("r")(m) == pytest.approx(1000 * o.ParamSum("r")(snap)) and snap.info("ke")[1].ratio("km^2 s^-2") == pytest.approx(1)


def test_running(snap, spark, tmp_path):
    snap.df.write.parquet(f"{tmp_path}/in")
    stream = o.Snapshot(spark.readStream.schema(snap.df.schema).parquet(f"{tmp_path}/in"))
    q = running(stream, {"mass": o.ParamSum(), "n": o.Count()}).writeStream.outputMode("complete").format("memory").queryName("running_mass").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("running_mass").agg(F.sum("n")).first()[0] == 300


def test_expressions(snap, arrays):
    m = o.ParamSum()
    total = arrays["mass"].sum()
    assert ((m + 1) * 2 - m / 2)(snap) == pytest.approx((total + 1) * 2 - total / 2) and (2 / m)(snap) == pytest.approx(2 / total)
    assert (m / 0)(snap) == math.inf and m.clip(0, 1)(snap) == 1.0 and m.gt(3)(snap) is True
    assert isinstance(o.Constant(2) + o.Constant(3), o.Constant)
    with pytest.raises(TypeError):
        bool(m)


def test_parameters_and_flow(snap):
    s = snap
    half = o.ParamContain("r", 0.5, "mass")
    two = o.Count().filter(o.Sphere(lambda ctx, snap: ctx.column(half)))
    one = o.Count().filter(o.Sphere(half))
    assert two(s) == one(s) > 0
    assert not half.has_dynamic_param() and half.params(s)["cal_key"] == "r" and half.params(s).frac == 0.5
    assert one.format_flow().endswith("filter Sphere -> calculate Count")
    cache = {}
    first, again = (o.ParamSum("mass").run(s, o.RunOptions(cache=cache, record="outputs")) for _ in range(2))
    assert first.value == again.value and not first.cached and again.cached and "cached" in again.report()


def test_reductions_and_places(spark):
    x = np.array([3.0, 1.0, np.nan, 2.0])
    s = o.Snapshot(spark.createDataFrame([(i, float(v), float(i % 2)) for i, v in enumerate(x)], "k1 long, x double, mass double"), units={"pos": "kpc"}, order=("k1",))
    assert math.isnan(s.reduce("x", "max").value) and s.reduce("x", "nanmax").value == 3 and s.reduce("x", "nanmedian").value == 2 and s.reduce("mass", "std").value == 0.5
    assert s.reduce("x", "nanmax").in_units("pc") == pytest.approx(3000) and s.reduce("x", "nanvar").unit.dims == o.Unit.parse("kpc^2").dims
    assert [q.value for q in s.topk("x", 2)] == [3.0, 2.0] and [q.value for q in s.topk("x", -1)] == [1.0]
    assert sorted(tuple(r) for r in s.cumsum("mass", "k1").collect()) == [(0.0, 0.0), (1.0, 1.0), (2.0, 1.0), (3.0, 2.0)]
    assert sorted(r["k1"] for r in s.select(slice(1, 3)).df.collect()) == [1, 2] and s.select(3).df.count() == 1


def test_log_lines(capsys):
    from orrery import log

    log.set_format("%(message)s")
    log.set_format("now: %(message)s")
    log.set_level("info")
    log.logger.info("told")
    log.logger.debug("not told")
    assert capsys.readouterr().err.splitlines()[-1:] == ["now: told"] and len(log.logger.handlers) == 1
    log.logger.removeHandler(log.logger.handlers[0])
    log.set_level("warning")
