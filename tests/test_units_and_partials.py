"""Columns with units, and user-defined aggregates from partial states."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import orrery as o
from orrery.functions.quantities import UnitColumn, cross, text_of
from orrery.operators.partials import PARTIALS, Folded, Partial, folded, histogram


@pytest.fixture(scope="module")
def snap(spark):
    rng = np.random.default_rng(3)
    return o.from_arrays(spark, {"pos": rng.normal(size=(50, 3)), "vel": rng.normal(size=(50, 3)), "mass": rng.uniform(1, 2, 50)}, units={"pos": "kpc", "vel": "km s^-1", "mass": "Msol"})


def test_dimensions_are_carried(snap):
    m, x, v = snap.quantity("mass"), snap.quantity("x"), snap.quantity("vel")
    p = snap.df.toPandas()
    got = snap.aggregate(e=(0.5 * m * v[0] ** 2).sum(), r=(x * x).sqrt().mean(), w=x.mean(m), top=(x + "1000 pc").max(), var=x.var(), ratio=(x / "1 pc").max())
    assert got["e"].in_units("Msol km^2 s^-2") == pytest.approx((0.5 * p.mass * p.vx**2).sum()) and got["r"].in_units("pc") == pytest.approx(1000 * p.x.abs().mean())
    assert got["w"].value == pytest.approx((p.x * p.mass).sum() / p.mass.sum()) and got["top"].in_units("kpc") == pytest.approx(p.x.max() + 1)
    assert got["var"].in_units("kpc^2") == pytest.approx(p.x.var(ddof=0)) and got["ratio"].in_units("1") == pytest.approx(1000 * p.x.max())
    assert snap.df.where(x > "500 pc").count() == snap.df.where(x > 0.5).count() == (p.x > 0.5).sum()
    jz = cross(snap.quantity("pos"), v)[2]
    assert jz.unit.ratio("kpc km s^-1") == pytest.approx(1) and (1 / x).unit.ratio("kpc^-1") == pytest.approx(1)


def test_what_does_not_fit_fails_before_a_plan(snap):
    m, x, v = snap.quantity("mass"), snap.quantity("x"), snap.quantity("vx")
    for wrong in (lambda: x + v, lambda: x < m, lambda: x - "3 km s^-1", lambda: x.to("Msol"), lambda: x.clip(None, "1 s"), lambda: x.apply(F.exp), lambda: m.equals(x)):
        with pytest.raises(ValueError, match="convertible"):
            wrong()
    with pytest.raises(TypeError):
        bool(x)
    with pytest.raises(TypeError):
        x**m
    with pytest.raises(TypeError):
        UnitColumn.of(object())


def test_units_stay_in_the_schema(snap, tmp_path, spark):
    s = snap.with_quantities(ekin=0.5 * snap.quantity("mass") * snap.quantity("vx") ** 2, near=snap.quantity("x").clip("-100 pc", "0.1 kpc"))
    s.df.write.parquet(f"{tmp_path}/q")
    back = UnitColumn.from_frame(spark.read.parquet(f"{tmp_path}/q"), "ekin")
    assert back.unit.ratio("Msol km^2 s^-2") == pytest.approx(1) and s.unit_of("near").ratio("kpc") == pytest.approx(1)
    assert s.aggregate(n=abs(s.quantity("near")).max())["n"].in_units("pc") == pytest.approx(100)
    for text in ("kpc", "km s^-1", "Msol kpc^-3"):
        assert text_of(o.Unit.parse(text)) == text
    odd = o.Unit.parse("kpc") ** 2 / o.Unit.parse("Myr")
    assert o.Unit.parse(text_of(odd)).ratio(odd) == pytest.approx(1)
    assert (-snap.quantity("x")).round(1).astype("float").unit == snap.unit_of("x") and snap.quantity("x").to("kpc").number is not None


def test_partial_states_are_all_that_is_shuffled(spark):
    rng = np.random.default_rng(0)
    rows = pd.DataFrame({"g": rng.integers(0, 3, 4000), "v": rng.gamma(2.0, size=4000), "w": rng.uniform(0.5, 2, 4000)})
    rows.loc[::50, "v"] = np.nan
    df = spark.createDataFrame(rows).repartition(7)
    got = {r["g"]: r["value"] for r in folded(df, F.col("g"), F.col("v"), PARTIALS["kurtosis"]).collect()}
    for g, x in rows.dropna().groupby("g")["v"]:
        d = x - x.mean()
        assert got[g] == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
    got = {r["g"]: r["value"] for r in folded(df, F.col("g"), F.col("v"), histogram([0, 1, 2, 9]), F.col("w")).collect()}
    for g, x in rows.dropna().groupby("g"):
        assert np.allclose(got[g], np.histogram(x["v"], [0, 1, 2, 9], weights=x["w"])[0])
    assert folded(df.limit(0), F.col("g"), F.col("v"), PARTIALS["kurtosis"]).count() == 0


def test_a_user_statistic_in_profiles_and_calculators(snap):
    o.partial_statistic("spread", Partial(lambda: np.array([np.inf, -np.inf]), lambda s, x, w: np.array([min(s[0], x.min()), max(s[1], x.max())]), lambda a, b: np.array([min(a[0], b[0]), max(a[1], b[1])]), lambda s: s[1] - s[0]))
    pr, p = o.RadialProfile(snap, nbins=3), snap.df.toPandas()
    r = np.sqrt(p.x**2 + p.y**2 + p.z**2)
    at = np.clip(np.digitize(r, pr.rbins_edges, right=True) - 1, 0, 2)
    assert np.allclose(pr["mass"]["spread"], [np.ptp(p.mass[at == i]) for i in range(3)])
    whole = Folded(PARTIALS["spread"], "mass")
    assert whole(snap) == pytest.approx(np.ptp(p.mass)) and (2 * whole)(snap) == pytest.approx(2 * np.ptp(p.mass))
    assert np.isnan(whole(snap.where(F.lit(False)))) and whole.filter(o.Sphere("1 kpc"))(snap) == pytest.approx(np.ptp(p.mass[r < 1]))
    with pytest.raises(ValueError, match="no statistic"):
        pr["mass"]["nothing"]
