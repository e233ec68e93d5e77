"""A query for each operator over the shared tables, and the same in SQL for DuckDB.

Results of division, roots and sums of them are rounded on both sides: the order of a
parallel sum moves the last places.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import UnitColumn, cross, dot
from .operators import (
    AlignVec, AngMomVec, Annulus, BandPass, CenPos, CenVel, Count, Cuboid, Disc, FamilyFilter, Folded, Gravity, HighPass, KappaRot, KappaRotMean, LowPass, ParamContain, ParamSum, PatternSpeed, Profile, RadialProfile,
    RadiusAtSurfaceDensity, ShiftPosTo, ShiftVelTo, SolarNeighborhood, Sphere, SpinParam, StarAgeProfile, SurfaceDensity, VirialRadius, VolumeDensity, WrapBox, calculate_acceleration, calculate_potential, histogram,
)
from .operators.partials import PARTIALS
from .plans import Pipeline
from .plans.core import Calculator
from .snapshot import Snapshot
from .sources import PARTICLES_E_SQL, PARTICLES_L_SQL, STARS_EV_SQL, particles_e, particles_l, read_gadget, read_snapshot, stars_ev, write_gadget, write_snapshot
from .units import Unit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

P = f"WITH p AS ({PARTICLES_L_SQL}),\nq AS (SELECT *, sqrt(x*x+y*y+z*z) AS r, sqrt(x*x+y*y) AS rxy, 0.5*(vx*vx+vy*vy+vz*vz) AS ke, (x*vy-y*vx)/sqrt(x*x+y*y) AS vcxy,\n  (x*vx+y*vy+z*vz)/sqrt(x*x+y*y+z*z) AS vr, (z*(x*vx+y*vy)/sqrt(x*x+y*y)-vz*sqrt(x*x+y*y))/sqrt(x*x+y*y+z*z) AS vtheta FROM p)"
ORDER = "k1, k2, k3, k4, temp, age"
EP = f"WITH e AS ({PARTICLES_E_SQL})"


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def one(calc: Calculator, *names: str, digits: int = 6, view: Callable = particles_l) -> Query:
    return lambda spark, d: rounded(calc.frame(view(spark, d)).toDF(*names), digits)


# --- filters: number and mass of what they keep
TWO = {"n": Count(), "mass": ParamSum("mass")}


def filtered(name: str, f, where: str) -> None:
    add(name, lambda spark, d: Pipeline({k: c.filter(f) for k, c in TWO.items()}).frame(particles_l(spark, d)).toDF("n", "mass"), f"{P} SELECT count(*) AS n, sum(mass) AS mass FROM q WHERE {where}")


filtered("filter_sphere", Sphere(20.25), "x*x+y*y+z*z < 20.25*20.25")
filtered("filter_sphere_cen", Sphere(20.25, (3.0, -4.0, 5.0)), "(x-3)*(x-3)+(y+4)*(y+4)+(z-5)*(z-5) < 20.25*20.25")
filtered("filter_family", FamilyFilter("stars"), "family = 'star'")
filtered("filter_cuboid", Cuboid(-10.25, -20.25, -15.25, 12.25, 18.25, 9.25), "x > -10.25 AND y > -20.25 AND z > -15.25 AND x < 12.25 AND y < 18.25 AND z < 9.25")
filtered("filter_cuboid_default", Cuboid(-10.25), "x > -10.25 AND y > -10.25 AND z > -10.25 AND x < 10.25 AND y < 10.25 AND z < 10.25")
filtered("filter_disc", Disc(20.25, 5.25), "x*x+y*y < 20.25*20.25 AND abs(z) < 5.25")
filtered("filter_annulus", Annulus(10.25, 20.25), "x*x+y*y+z*z < 20.25*20.25 AND NOT x*x+y*y+z*z < 10.25*10.25")
filtered("filter_bandpass", BandPass("x", -5, 7.5), "x > -5 AND x < 7.5")
filtered("filter_highpass", HighPass("temp", 30000.0), "temp > 30000")
filtered("filter_lowpass", LowPass("r", 25.25), "r < 25.25")
filtered("filter_solar", SolarNeighborhood(5.25, 20.25, 4.25), "x*x+y*y < 20.25*20.25 AND abs(z) < 4.25 AND NOT (x*x+y*y < 5.25*5.25 AND abs(z) < 4.25)")
filtered("filter_and", FamilyFilter("gas") & Sphere(20.25), "family = 'gas' AND x*x+y*y+z*z < 20.25*20.25")
filtered("filter_or", FamilyFilter("gas") | LowPass("temp", 20000.0), "family = 'gas' OR temp < 20000")
filtered("filter_not", ~(FamilyFilter("dm") & HighPass("y", 0.0)), "NOT (family = 'dm' AND y > 0)")

# --- sums, centres, densities
add("param_sum_star_sphere", lambda spark, d: Pipeline({k: c.filter(FamilyFilter("star") & Sphere(20.25)) for k, c in TWO.items()}).frame(particles_l(spark, d)).toDF("n", "mass"), f"{P} SELECT count(*) AS n, sum(mass) AS mass FROM q WHERE family = 'star' AND x*x+y*y+z*z < 20.25*20.25")
add("param_sum_family", one(ParamSum("mass").filter(FamilyFilter("star")), "mass"), f"{P} SELECT sum(mass) AS mass FROM q WHERE family = 'star'")
add("volume_density", one(VolumeDensity(20.25, "mass", 5.25), "density"), f"{P} SELECT round(sum(mass) / (4.0/3.0*pi()*(20.25^3 - 5.25^3)), 6) AS density FROM q WHERE x*x+y*y+z*z < 20.25*20.25 AND x*x+y*y+z*z >= 5.25*5.25")
add("surface_density", one(SurfaceDensity(20.25), "density"), f"{P} SELECT round(sum(mass) / (pi()*20.25*20.25), 6) AS density FROM q WHERE rxy > 0 AND rxy < 20.25")
add("com_pos", one(CenPos("com"), "x", "y", "z"), f"{P} SELECT round(sum(mass*x)/sum(mass), 6) AS x, round(sum(mass*y)/sum(mass), 6) AS y, round(sum(mass*z)/sum(mass), 6) AS z FROM q")
add("com_vel", one(CenVel("com"), "vx", "vy", "vz"), f"{P} SELECT round(sum(mass*vx)/sum(mass), 6) AS vx, round(sum(mass*vy)/sum(mass), 6) AS vy, round(sum(mass*vz)/sum(mass), 6) AS vz FROM q")
add("pot_center", one(CenPos("pot"), "x", "y", "z"), f"{P} SELECT x, y, z FROM q ORDER BY phi, {ORDER} LIMIT 1")
add("angmom_vec", one(AngMomVec(), "jx", "jy", "jz"), f"{P} SELECT sum(mass*(y*vz-z*vy)) AS jx, sum(mass*(z*vx-x*vz)) AS jy, sum(mass*(x*vy-y*vx)) AS jz FROM q")
add("kappa_rot", one(KappaRot(), "kappa"), f"{P} SELECT round(sum(0.5*mass*vcxy*vcxy)/sum(mass*ke), 6) AS kappa FROM q")
add("kappa_rot_mean", one(KappaRotMean(), "kappa"), f"{P} SELECT round(avg(CASE WHEN ke > 0 THEN 0.5*vcxy*vcxy/ke END), 6) AS kappa FROM q")
_HALF, _CROSS = "(0.5*(sum(mass*x*x)-sum(mass*y*y)))", "sum(mass*x*y)"
add("pattern_speed", one(PatternSpeed().filter(FamilyFilter("star")), "omega", digits=9), f"{P} SELECT round(0.5*({_HALF}*sum(mass*(x*vy+y*vx)) - sum(mass*(x*vx-y*vy))*{_CROSS})/({_HALF}*{_HALF}+{_CROSS}*{_CROSS}), 9) AS omega FROM q WHERE family = 'star'")
add("spin_param", one(SpinParam(g=1.0), "spin", digits=9), f"{P} SELECT round(sqrt(pow(sum(mass*(y*vz-z*vy)),2)+pow(sum(mass*(z*vx-x*vz)),2)+pow(sum(mass*(x*vy-y*vx)),2)) / (sqrt(2.0)*sum(mass)*sqrt(sum(mass)/max(r))*max(r)), 9) AS spin FROM q")

# --- order statistics
PREFIX = f"c AS (SELECT r, sum(mass) OVER (ORDER BY r, mass, {ORDER} ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (ORDER BY r, mass, {ORDER}) AS i, sum(mass) OVER () AS t FROM q),\nf AS (SELECT r, i, (c - first_value(c) OVER (ORDER BY i)) / (t - first_value(c) OVER (ORDER BY i)) AS f FROM c),\ng AS (SELECT r, f, lag(r) OVER (ORDER BY i) AS r0, lag(f) OVER (ORDER BY i) AS f0 FROM f)"


def containing(p: float) -> str:
    return f"(SELECT round(r0 + (r - r0) * ({p} - f0) / (f - f0), 6) FROM g WHERE f >= {p} AND f0 < {p})"


add("param_contain", one(ParamContain("r", 0.5, "mass"), "r_half"), f"{P},\n{PREFIX} SELECT {containing(0.5)} AS r_half")
add("param_contain_multi", one(ParamContain("r", [0.1, 0.5, 0.9], "mass"), "p10", "p50", "p90"), f"{P},\n{PREFIX} SELECT {containing(0.1)} AS p10, {containing(0.5)} AS p50, {containing(0.9)} AS p90")
add("virial_radius", one(VirialRadius(200.0, 1e-3), "r_vir"), f"{P},\n{PREFIX} SELECT round(max(CASE WHEN c >= 200.0*1e-3*4/3*pi()*pow(r,3) THEN r END), 6) AS r_vir FROM c")
_DENSITY = RadiusAtSurfaceDensity(lambda s: s.df.agg(F.sum("mass")).scalar() / (np.pi * 45.0 * 45.0), mode="total", rmin=5.0, rmax=50.0, eps=0.01)
_SHELL_DENSITY = RadiusAtSurfaceDensity(lambda s: F.lit(0.7) * s.df.agg(F.sum("mass")).scalar() / (np.pi * 45.0 * 45.0), mode="shell", rmin=5.0, rmax=55.0, eps=4.0, points=64)
_BRACKET = """t AS (SELECT sum(mass) / (pi() * 45.0 * 45.0) AS t FROM q),
grid AS (SELECT g, 5.0 + g * ((50.0 - 5.0) / 255) AS r FROM range(256) AS x(g)),
d AS (SELECT g, any_value(grid.r) AS r, coalesce(sum(mass), 0) / (pi() * any_value(grid.r) * any_value(grid.r)) - any_value(t) AS d FROM grid CROSS JOIN t LEFT JOIN q ON q.rxy <= grid.r GROUP BY g),
s AS (SELECT g, r AS lo, lead(r) OVER (ORDER BY g) AS hi, (d < 0) <> (lead(d) OVER (ORDER BY g) < 0) AS crossed FROM d),
br AS (SELECT g, lo, hi FROM s WHERE crossed ORDER BY g LIMIT 1)"""
add("radius_at_sigma_bracket", lambda spark, d: _DENSITY.bracket(particles_l(spark, d)).select("g"), f"""{P},
{_BRACKET} SELECT g FROM br""")
add("radius_at_sigma", lambda spark, d: rounded(_DENSITY.frame(particles_l(spark, d)), 6), f"""{P},
{_BRACKET},
m AS (SELECT rxy AS r, sum(sum(mass)) OVER (ORDER BY rxy) AS m, sum(sum(mass)) OVER (ORDER BY rxy) - sum(mass) AS was FROM q GROUP BY rxy),
n AS (SELECT r, m, was, lead(r) OVER (ORDER BY r) AS nx FROM m),
c AS (SELECT greatest(r, lo) AS r, m, CASE WHEN r > lo THEN was ELSE m END AS was, least(coalesce(nx, hi), hi) AS nx, t FROM n, br, t WHERE r <= hi AND (nx IS NULL OR nx > lo))
SELECT round(min(CASE WHEN (was / (pi()*r*r) < t) <> (m / (pi()*r*r) < t) THEN r WHEN m / (pi()*r*r) >= t AND m / (pi()*nx*nx) < t THEN sqrt(m / (pi()*t)) END), 6) AS value FROM c""")
add("radius_at_sigma_shell", lambda spark, d: rounded(_SHELL_DENSITY.frame(particles_l(spark, d)), 6), f"""{P},
t AS (SELECT 0.7 * sum(mass) / (pi() * 45.0 * 45.0) AS t FROM q),
grid AS (SELECT g, 5.0 + g * ((55.0 - 5.0) / 63) AS r FROM range(64) AS x(g)),
d AS (SELECT g, any_value(grid.r) AS r, coalesce(sum(mass), 0) / (pi() * 8.0 * any_value(grid.r)) - any_value(t) AS d FROM grid CROSS JOIN t LEFT JOIN q ON q.rxy >= grid.r - 2.0 AND q.rxy <= grid.r + 2.0 GROUP BY g),
s AS (SELECT g, r AS lo, lead(r) OVER (ORDER BY g) AS hi, (d < 0) <> (lead(d) OVER (ORDER BY g) < 0) AS crossed FROM d),
br AS (SELECT g, lo, hi FROM s WHERE crossed ORDER BY g LIMIT 1),
ev AS (SELECT r, late, sum(d) AS d FROM (SELECT rxy - 2.0 AS r, 0 AS late, mass AS d FROM q UNION ALL SELECT rxy + 2.0, 1, -mass FROM q) GROUP BY r, late),
m AS (SELECT r, late, sum(d) OVER (ORDER BY r, late) AS m, sum(d) OVER (ORDER BY r, late) - d AS was, lead(r) OVER (ORDER BY r, late) AS nx FROM ev),
c AS (SELECT greatest(r, lo) AS r, m, CASE WHEN r > lo THEN was ELSE m END AS was, least(coalesce(nx, hi), hi) AS nx, t FROM m, br, t WHERE r <= hi AND (nx IS NULL OR nx > lo))
SELECT round(min(CASE WHEN (was / (pi()*8.0*r) < t) <> (m / (pi()*8.0*r) < t) THEN r WHEN m / (pi()*8.0*r) >= t AND m / (pi()*8.0*nx) < t THEN m / (pi()*8.0*t) END), 6) AS value FROM c""")

# --- algebra, pipelines, parameters
_M, _K = ParamSum("mass"), KappaRot()
add("expr_algebra", one((_M * 2 + 3 * _M - _M / 4) ** 0.5 + abs(-_K), "value"), f"{P} SELECT round(sqrt(sum(mass)*2+3*sum(mass)-sum(mass)/4) + abs(-(sum(0.5*mass*vcxy*vcxy)/sum(mass*ke))), 6) AS value FROM q")
add("clip", one(CenPos("com").clip(-0.01, 0.01), "x", "y", "z"), f"{P} SELECT round(least(greatest(sum(mass*x)/sum(mass), -0.01), 0.01), 6) AS x, round(least(greatest(sum(mass*y)/sum(mass), -0.01), 0.01), 6) AS y, round(least(greatest(sum(mass*z)/sum(mass), -0.01), 0.01), 6) AS z FROM q")
add("compare", one(_K.gt(0.1), "above"), f"{P} SELECT sum(0.5*mass*vcxy*vcxy)/sum(mass*ke) > 0.1 AS above FROM q")
add("pipeline_multi", one(Pipeline({"mass": _M, "star_mass": _M.filter(FamilyFilter("star")), "star_n": Count().filter(FamilyFilter("star")), "kappa": _K}), "mass", "star_mass", "star_n", "kappa"), f"{P} SELECT sum(mass) AS mass, sum(mass) FILTER (WHERE family = 'star') AS star_mass, count(*) FILTER (WHERE family = 'star') AS star_n, round(sum(0.5*mass*vcxy*vcxy)/sum(mass*ke), 6) AS kappa FROM q")
add("combined", one(ParamSum("mass") & Count() & KappaRot(), "mass", "n", "kappa"), f"{P} SELECT sum(mass) AS mass, count(*) AS n, round(sum(0.5*mass*vcxy*vcxy)/sum(mass*ke), 6) AS kappa FROM q")
add("dynamic_sphere", one((ParamSum("mass") & Count()).filter(Sphere(0.75 * ParamContain("r", 0.5, "mass"))), "mass", "n"), f"{P},\n{PREFIX},\nh AS (SELECT r0 + (r - r0) * (0.5 - f0) / (f - f0) AS h FROM g WHERE f >= 0.5 AND f0 < 0.5) SELECT sum(mass) AS mass, count(*) AS n FROM q, h WHERE x*x+y*y+z*z < (0.75*h)*(0.75*h)")
add("dynamic_band", one(Count().filter(BandPass("temp", ParamContain("temp", 0.25, "mass"), ParamContain("temp", 0.75, "mass"))), "n"), f"""{P},
{PREFIX.replace("SELECT r, sum", "SELECT temp AS r, sum").replace("ORDER BY r, mass", "ORDER BY temp, mass")},
h AS (SELECT {", ".join(f"(SELECT r0 + (r - r0) * ({p} - f0) / (f - f0) FROM g WHERE f >= {p} AND f0 < {p}) AS {n}" for n, p in (("lo", 0.25), ("hi", 0.75)))})
SELECT count(*) AS n FROM q, h WHERE temp > lo AND temp < hi""")

# --- transforms
SIX = ParamSum("x") & ParamSum("y") & ParamSum("z") & Count().filter(Sphere(15.25))


def moved(name: str, t, x: str, y: str, z: str, with_: str = "") -> None:
    sql = f"{P}{with_}, w AS (SELECT {x} AS x, {y} AS y, {z} AS z FROM q) SELECT round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(z), 4) AS z, count(*) FILTER (WHERE x*x+y*y+z*z < 15.25*15.25) AS n FROM w"
    add(name, one(SIX.transform(t), "x", "y", "z", "n", digits=4), sql)


def wrap(c: str, low: float) -> str:
    return f"({c} - floor(({c} - ({low})) / 40.0) * 40.0)"


moved("wrap_center", WrapBox(40.0, "center"), *[wrap(c, -20.0) for c in "xyz"])
moved("wrap_upper", WrapBox(40.0, "upper"), *[wrap(c, 0.0) for c in "xyz"])
_RANGES = ", mr AS (SELECT " + ", ".join(f"max({wrap(c, -20.0)}) - min({wrap(c, -20.0)}) <= max({wrap(c, 0.0)}) - min({wrap(c, 0.0)}) AS c{c}" for c in "xyz") + " FROM q)"
moved("wrap_minirange", WrapBox(40.0), *[f"CASE WHEN (SELECT c{c} FROM mr) THEN {wrap(c, -20.0)} ELSE {wrap(c, 0.0)} END" for c in "xyz"], with_=_RANGES)
_COM = ", com AS (SELECT " + ", ".join(f"sum(mass*{c})/sum(mass) AS c{c}" for c in "xyz") + " FROM q{})"
moved("shift_com_then_sum", ShiftPosTo("com"), *[f"{c} - (SELECT c{c} FROM com)" for c in "xyz"], with_=_COM.format(""))
moved("measure_filter_shift", ShiftPosTo("com").measure_with(FamilyFilter("star") & Sphere(20.25)), *[f"{c} - (SELECT c{c} FROM com)" for c in "xyz"], with_=_COM.format(" WHERE family = 'star' AND x*x+y*y+z*z < 20.25*20.25"))
moved("shift_array", ShiftPosTo((1.0, -2.0, 0.5)), "x - 1", "y + 2", "z - 0.5")
add("transform_chain", one((CenPos("com") & CenVel("com") & Count().filter(Sphere(10.25))).transform(WrapBox(40.0, "center").then(ShiftPosTo("com"), ShiftVelTo("com"))), "x", "y", "z", "vx", "vy", "vz", "n", digits=4), f"{P}, w AS (SELECT mass, {', '.join(f'{wrap(c, -20.0)} AS {c}' for c in 'xyz')} FROM q){_COM.format('').replace('FROM q', 'FROM w')} SELECT 0.0 AS x, 0.0 AS y, 0.0 AS z, 0.0 AS vx, 0.0 AS vy, 0.0 AS vz, count(*) AS n FROM w, com WHERE (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz) < 10.25*10.25")
QUERIES["transform_chain"] = (lambda q: lambda spark, d: q(spark, d).select(*[(F.col(c) + 0.0).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")], "n"))(QUERIES["transform_chain"])
add("rotate_invariants", one((ParamSum("r") & ParamSum("ke") & AngMomVec()).transform(AlignVec(AngMomVec())), "r", "ke", "jx", "jy", "jz", digits=2), f"{P} SELECT round(sum(r), 2) AS r, round(sum(ke), 2) AS ke, 0.0 AS jx, 0.0 AS jy, round(sqrt(pow(sum(mass*(y*vz-z*vy)),2)+pow(sum(mass*(z*vx-x*vz)),2)+pow(sum(mass*(x*vy-y*vx)),2)), 2) AS jz FROM q")
QUERIES["rotate_invariants"] = (lambda q: lambda spark, d: q(spark, d).select("r", "ke", *[(F.col(c) + 0.0).alias(c) for c in ("jx", "jy")], "jz"))(QUERIES["rotate_invariants"])


def shrinking(rows: str, start: str) -> str:
    """The sphere as a recursive query over particles ``rows`` from ``start``: x, y, z, r."""
    inside = "(p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y)+(p.z-s.z)*(p.z-s.z) < s.r*s.r"
    return f"""WITH RECURSIVE p AS ({rows}), st AS ({start}), sph(i, x, y, z, r, n) AS (
  SELECT 0, x, y, z, r, CAST(1000000 AS BIGINT) FROM st
  UNION ALL
  SELECT s.i + 1, coalesce(sum(p.mass*p.x)/sum(p.mass), s.x), coalesce(sum(p.mass*p.y)/sum(p.mass), s.y), coalesce(sum(p.mass*p.z)/sum(p.mass), s.z), s.r * 0.7, count(p.mass)
  FROM sph s LEFT JOIN p ON {inside} WHERE s.n >= 100 GROUP BY s.i, s.x, s.y, s.z, s.r)
SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM sph ORDER BY i DESC LIMIT 1"""


_COM_START = "SELECT x, y, z, 0.7 * (SELECT sqrt(max((p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z))) FROM p) AS r FROM (SELECT sum(mass*x)/sum(mass) AS x, sum(mass*y)/sum(mass) AS y, sum(mass*z)/sum(mass) AS z FROM p) c"
add("shrinking_sphere", one(CenPos("ssc").filter(FamilyFilter("star")), "x", "y", "z"), shrinking(f"SELECT * FROM ({PARTICLES_L_SQL}) WHERE family = 'star'", _COM_START))
add("hybrid_center", one(CenPos("hyb"), "x", "y", "z"), shrinking(PARTICLES_L_SQL, f"SELECT x, y, z, 5.0 AS r FROM p ORDER BY phi, {ORDER} LIMIT 1"))

# --- profiles
LIN = [0.25 + 6.0 * i for i in range(9)]
LOG = [float(v) for v in np.logspace(np.log10(2.03), np.log10(50.77), 7)]


def bin_case(key: str, edges: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {key} > {a!r} AND {key} <= {b!r} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + " END"


STATS = {
    "mean": "sum(mass*temp)/sum(mass)", "sum": "sum(temp)", "sum_w": "sum(temp*mass)", "p16": None, "median": None, "rms": "sqrt(sum(mass*temp*temp)/sum(mass))",
    "disp": "sqrt(sum(mass*temp*temp)/sum(mass) - pow(sum(mass*temp)/sum(mass), 2))", "abs": "sum(mass*abs(phi))/sum(mass)",
}
UNWEIGHTED = {"mean": "avg(temp)", "sum": "sum(temp)", "sum_w": "sum(temp)", "p16": "quantile_cont(temp, 0.16)", "median": "quantile_cont(temp, 0.5)", "rms": "sqrt(avg(temp*temp))", "disp": "sqrt(avg(temp*temp) - pow(avg(temp), 2))", "abs": "avg(abs(phi))"}


def made(kind: str, snap: Snapshot, weight: str | None) -> Profile:
    if kind == "lin":
        return RadialProfile(snap, 3, weight, bins_type="lin", nbins=8, bin_min=LIN[0], bin_max=LIN[-1])
    if kind == "log":
        return RadialProfile(snap, 3, weight, bins_type="log", nbins=6, bin_min=LOG[0], bin_max=LOG[-1])
    return RadialProfile(snap, 3, weight, bins_type="equaln", nbins=5)


def profiled(kind: str, stat: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        name = ("phi" if stat == "abs" else "temp") + "_" + stat
        return made(kind, particles_l(spark, d), None).table(name).where("npart > 0").select("bin", F.col("npart").alias("n"), F.round(F.col(name), 3).alias("value"))

    return run


_RANKED = "o AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i, count(*) OVER () AS n FROM q),\ned AS (SELECT " + ", ".join(["min(r) AS e0", *(f"max(CASE WHEN i = n * {i} // 5 THEN r END) AS e{i}" for i in range(1, 5)), "max(r) AS e5"]) + " FROM o),\n"
for _kind, _edges in (("lin", LIN), ("log", LOG), ("equaln", None)):
    for _stat, _sql in UNWEIGHTED.items():
        if _edges is not None:
            _b = f"b AS (SELECT *, {bin_case('r', _edges)} AS bin FROM q)"
        else:
            _case = " ".join(f"WHEN r > e{i} AND r <= e{i + 1} THEN {i}" for i in range(5))
            _b = f"{_RANKED}b AS (SELECT q.*, CASE WHEN r = e0 THEN 0 {_case} END AS bin FROM q, ed)"
        add(f"profile_{_kind}_{_stat}", profiled(_kind, _stat), f"{P},\n{_b} SELECT bin, count(*) AS n, round({_sql}, 3) AS value FROM b WHERE bin IS NOT NULL GROUP BY bin")

_BL = f"b AS (SELECT *, {bin_case('r', LIN)} AS bin FROM q)"
_SHELL = "(4.0/3.0*pi()*(pow(0.25+6.0*(bin+1), 3) - pow(0.25+6.0*bin, 3)))"


def weighted_stats(spark: SparkSession, d: str) -> DataFrame:
    names = ["temp_mean", "temp_sum", "temp_sum_w", "temp_rms", "temp_disp"]
    return rounded(made("lin", particles_l(spark, d), "mass").table(*names).where("npart > 0").select("bin", *names), 3)


add("profile_weighted", weighted_stats, f"{P},\n{_BL} SELECT bin, " + ", ".join(f"round({STATS[s]}, 3) AS temp_{s}" for s in ("mean", "sum", "sum_w", "rms", "disp")) + " FROM b WHERE bin IS NOT NULL GROUP BY bin")
add("profile_weighted_p16", lambda spark, d: made("lin", particles_l(spark, d), "mass").table("temp_p16").where("npart > 1").select("bin", F.round("temp_p16", 3).alias("value")), f"""{P},
{_BL},
c AS (SELECT bin, temp, row_number() OVER w AS i, sum(mass) OVER w AS c, sum(mass) OVER (PARTITION BY bin) AS t FROM b WHERE bin IS NOT NULL WINDOW w AS (PARTITION BY bin ORDER BY temp, mass, {ORDER} ROWS UNBOUNDED PRECEDING)),
f AS (SELECT bin, temp, i, (c - first_value(c) OVER (PARTITION BY bin ORDER BY i)) / (t - first_value(c) OVER (PARTITION BY bin ORDER BY i)) AS f FROM c),
g AS (SELECT bin, temp, f, lag(temp) OVER (PARTITION BY bin ORDER BY i) AS t0, lag(f) OVER (PARTITION BY bin ORDER BY i) AS f0 FROM f)
SELECT bin, round(t0 + (temp - t0) * (0.16 - f0) / (f - f0), 3) AS value FROM g WHERE f >= 0.16 AND f0 < 0.16""")
add("profile_density", lambda spark, d: made("lin", particles_l(spark, d), None).table("density").where("npart > 0").select("bin", F.round("density", 6).alias("density")), f"{P},\n{_BL} SELECT bin, round(sum(mass) / {_SHELL}, 6) AS density FROM b WHERE bin IS NOT NULL GROUP BY bin")
add("profile_mass_enc", lambda spark, d: made("lin", particles_l(spark, d), None).table("mass_enc").select("bin", F.col("mass_enc")), f"{P},\n{_BL} SELECT bin, sum(sum(mass)) OVER (ORDER BY bin) AS mass_enc FROM b WHERE bin IS NOT NULL GROUP BY bin")
add("profile_beta", lambda spark, d: made("lin", particles_l(spark, d), None).table("beta").where("npart > 0").select("bin", F.round("beta", 6).alias("beta")), f"{P},\n{_BL} SELECT bin, round(1 - (avg(vcxy*vcxy) + avg(vtheta*vtheta)) / (2 * avg(vr*vr)), 6) AS beta FROM b WHERE bin IS NOT NULL GROUP BY bin")
add("profile_subfamily", lambda spark, d: made("lin", particles_l(spark, d), None).s.table("mass_sum").where("npart > 0").select("bin", F.col("npart").alias("n"), F.col("mass_sum").alias("mass")), f"{P},\n{_BL} SELECT bin, count(*) AS n, sum(mass) AS mass FROM b WHERE bin IS NOT NULL AND family = 'star' GROUP BY bin")
add("profile_2d", lambda spark, d: rounded(RadialProfile(particles_l(spark, d), 2, bins_type=tuple(LIN)).table("density").where("npart > 0").select("bin", F.col("npart").alias("n"), "density")), f"{P},\nb AS (SELECT *, {bin_case('rxy', LIN)} AS bin FROM q) SELECT bin, count(*) AS n, round(sum(mass) / (pi()*(pow(0.25+6.0*(bin+1), 2) - pow(0.25+6.0*bin, 2))), 6) AS density FROM b WHERE bin IS NOT NULL GROUP BY bin")
add("profile_empty_bins", lambda spark, d: Profile.of(particles_l(spark, d), bins_by="x", bins_area="length", bins_type=(-24.75, -24.625, -24.25, 0.25, 30.0, 40.0)).table("mass_sum").select("bin", F.col("npart").alias("n"), F.isnan("mass_sum").alias("empty")), f"{P},\nb AS (SELECT *, {bin_case('x', [-24.75, -24.625, -24.25, 0.25, 30.0, 40.0])} AS bin FROM q) SELECT CAST(i AS INTEGER) AS bin, count(b.bin) AS n, count(b.bin) = 0 AS empty FROM range(5) AS t(i) LEFT JOIN b ON b.bin = i GROUP BY i")
add("particles_at_bin", lambda spark, d: made("lin", particles_l(spark, d), None).particles_at_bin([1, 3]).select("bin", "family", "x", "y", "z", "mass", "k1", "k2", "k3", "k4"), f"{P},\n{_BL} SELECT bin, family, x, y, z, mass, k1, k2, k3, k4 FROM b WHERE bin IN (1, 3)")
AGES = [0.97 + 5.0 * i for i in range(7)]
add("profile_sfr_age", lambda spark, d: rounded(StarAgeProfile(stars_ev(spark, d), bins_type=tuple(AGES)).table("sfr").where("npart > 0").select("bin", F.col("npart").alias("n"), "sfr")), f"WITH s AS ({STARS_EV_SQL}), b AS (SELECT *, {bin_case('age', AGES)} AS bin FROM s) SELECT bin, count(*) AS n, round(sum(mass) / 5.0, 6) AS sfr FROM b WHERE bin IS NOT NULL GROUP BY bin")

add("profile_cylindrical", lambda spark, d: rounded(RadialProfile(particles_l(spark, d), 2, bins_type=tuple(LIN), bins_area="cylindrical_shell", options=(("z", 2.5),)).table("density").where("npart > 0").select("bin", "density")), f"{P},\nb AS (SELECT *, {bin_case('rxy', LIN)} AS bin FROM q) SELECT bin, round(sum(mass) / (2.5*pi()*(pow(0.25+6.0*(bin+1), 2) - pow(0.25+6.0*bin, 2))), 6) AS density FROM b WHERE bin IS NOT NULL GROUP BY bin")
add("profile_bins", lambda spark, d: rounded(made("lin", particles_l(spark, d), None).edges.table(spark).select(F.col("bin").cast("long").alias("bin"), "center", "dr", "size")), "SELECT i AS bin, 0.25 + 6.0*i + 3.0 AS center, 6.0 AS dr, round(4.0/3.0*pi()*(pow(0.25+6.0*(i+1), 3) - pow(0.25+6.0*i, 3)), 6) AS size FROM range(8) AS t(i)")
add("compare_all", one(_K.lt(0.1) & _K.le(0.1) & _K.ge(0.1) & _K.ne(0.1) & _K.eq_(0.1), "lt", "le", "ge", "ne", "eq"), f"{P}, k AS (SELECT sum(0.5*mass*vcxy*vcxy)/sum(mass*ke) AS k FROM q) SELECT k < 0.1 AS lt, k <= 0.1 AS le, k >= 0.1 AS ge, k <> 0.1 AS ne, k = 0.1 AS eq FROM k")
add("slice_positions", lambda spark, d: Pipeline(TWO).frame(particles_l(spark, d).select(slice(100, 5000, 3))).toDF("n", "mass"), f"{P}, o AS (SELECT mass, row_number() OVER (ORDER BY {ORDER}) - 1 AS i FROM q) SELECT count(*) AS n, sum(mass) AS mass FROM o WHERE i >= 100 AND i < 5000 AND (i - 100) % 3 = 0")
_JS = "j AS (SELECT sum(mass*(y*vz-z*vy)) AS a, sum(mass*(z*vx-x*vz)) AS b, sum(mass*(x*vy-y*vx)) AS c FROM q), zz AS (SELECT a/sqrt(a*a+b*b+c*c) AS z0, b/sqrt(a*a+b*b+c*c) AS z1, c/sqrt(a*a+b*b+c*c) AS z2 FROM j), xx AS (SELECT z2/sqrt(z2*z2+z0*z0) AS x0, 0.0 AS x1, -z0/sqrt(z2*z2+z0*z0) AS x2, z0, z1, z2 FROM zz), rot AS (SELECT *, z1*x2-z2*x1 AS y0, z2*x0-z0*x2 AS y1, z0*x1-z1*x0 AS y2 FROM xx)"
add("rotate_vectors", lambda spark, d: rounded(AlignVec(AngMomVec()).apply(particles_l(spark, d)).df.select("k1", "k2", "x", "y", "z", "vx", "vy", "vz"), 4), f"{P}, {_JS} SELECT k1, k2, " + ", ".join(f"round({v}x*{r}0 + {v}y*{r}1 + {v}z*{r}2, 4) + 0.0 AS {v}{r}" for v in ("", "v") for r in "xyz") + " FROM q, rot")
QUERIES["rotate_vectors"] = (lambda q: lambda spark, d: q(spark, d).select("k1", "k2", *[(F.col(c) + 0.0).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")]))(QUERIES["rotate_vectors"])

_MOMENTS = ", ".join(f"avg(pow(temp - m, {k})) AS m{k}" for k in (2, 3, 4))
add("profile_kurtosis", lambda spark, d: rounded(made("lin", particles_l(spark, d), None).table("temp_kurtosis", "temp_skewness").where("npart > 3").select("bin", "temp_kurtosis", "temp_skewness"), 5), f"""{P},
{_BL},
c AS (SELECT bin, temp, avg(temp) OVER (PARTITION BY bin) AS m FROM b WHERE bin IS NOT NULL)
SELECT bin, round(m4 / (m2*m2) - 3, 5) AS temp_kurtosis, round(m3 / pow(m2, 1.5), 5) AS temp_skewness FROM (SELECT bin, count(*) AS n, {_MOMENTS} FROM c GROUP BY bin) WHERE n > 3""")
add("folded_weighted_kurtosis", lambda spark, d: rounded(Folded(PARTIALS["kurtosis"], "temp", "mass").frame(particles_l(spark, d).s), 5), f"""{P},
c AS (SELECT temp, mass, (SELECT sum(mass*temp)/sum(mass) FROM q WHERE family = 'star') AS m FROM q WHERE family = 'star')
SELECT round(sum(mass) * sum(mass*pow(temp - m, 4)) / pow(sum(mass*pow(temp - m, 2)), 2) - 3, 5) AS value FROM c""")
add("folded_histogram", lambda spark, d: Folded(histogram([0.0, 10.0, 20.0, 30.0, 60.0]), "r").frame(particles_l(spark, d)).select(F.posexplode("value").alias("bin", "n")).select("bin", F.col("n").cast("long").alias("n")), f"""{P}
SELECT CAST(floor(least(r, 30.0) / 10) AS INTEGER) AS bin, count(*) AS n FROM q WHERE r <= 60 GROUP BY 1""")

# --- units
UNITS = {"pos": "kpc", "vel": "km s^-1", "mass": "Msol"}
_V2 = "(vx*vx+vy*vy+vz*vz)"
_PC_MYR = f"{(Unit.parse('km s^-1').ratio('pc Myr^-1'))!r}"


def with_units(spark: SparkSession, d: str) -> Snapshot:
    return replace(particles_l(spark, d), units=UNITS)


def units_energy(spark: SparkSession, d: str) -> DataFrame:
    """Kinetic energy by family, in solar masses km^2 / s^2 and in 10^40 J."""
    s = with_units(spark, d)
    vel = s.quantity("vel")
    energy = (0.5 * s.quantity("mass") * dot(vel, vel)).sum()
    return s.df.groupBy("family").agg(F.round(energy.to("Msol km^2 s^-2").column, 3).alias("energy"), F.round(energy.to("1e40 kg m^2 s^-2").column, 6).alias("joule"))


def units_momentum(spark: SparkSession, d: str) -> DataFrame:
    """Momentum and angular momentum in pc and Myr, and the mean speed along x in km / s."""
    s = with_units(spark, d)
    mass, pos, vel = (s.quantity(n) for n in ("mass", "pos", "vel"))
    px, jz = (mass * vel[0]).sum(), (mass * cross(pos, vel)[2]).sum()
    speed = px / mass.sum()
    return rounded(s.df.agg(px.to("Msol pc Myr^-1").column.alias("px"), jz.to("Msol kpc pc Myr^-1").column.alias("jz"), speed.to("km s^-1").column.alias("vx")), 5)


def units_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Particles within 20,000 pc that are faster than 15 pc / Myr, and their kinetic energy above that of this speed."""
    s = with_units(spark, d)
    v = s.quantity("v")
    near = s.where((s.quantity("r") < "20000 pc") & (v > "15 pc Myr^-1"))
    above = (v**2 - UnitColumn.of("15 pc Myr^-1") ** 2) / 2
    return near.df.agg(F.count(F.lit(1)).alias("n"), F.round((near.quantity("mass") * above).sum().to("Msol km^2 s^-2").column, 4).alias("above"))


add("units_energy", units_energy, f"{P} SELECT family, round(sum(0.5*mass*{_V2}), 3) AS energy, round(sum(0.5*mass*{_V2}) * {Unit.parse('Msol km^2 s^-2').ratio('1e40 kg m^2 s^-2')!r}, 6) AS joule FROM q GROUP BY family")
add("units_momentum", units_momentum, f"{P} SELECT round(sum(mass*vx) * {_PC_MYR}, 5) AS px, round(sum(mass*(x*vy - y*vx)) * {_PC_MYR}, 5) AS jz, round(sum(mass*vx)/sum(mass), 5) AS vx FROM q")
add("units_comparison", units_comparison, f"{P} SELECT count(*) AS n, round(sum(mass*({_V2} - pow(15/{_PC_MYR}, 2))/2), 4) AS above FROM q WHERE r < 20 AND sqrt({_V2}) > 15/{_PC_MYR}")

# --- reductions, volumes and places of a snapshot
def reductions(spark: SparkSession, d: str) -> DataFrame:
    s = particles_l(spark, d)
    names = ("min", "max", "mean", "std", "median", "ptp")
    return spark.createDataFrame([tuple(round(s.reduce("temp", n).value, 3) for n in names)], ", ".join(f"{n} double" for n in names))


def largest(spark: SparkSession, d: str) -> DataFrame:
    """The five largest and the three least masses of stars beyond a radius."""
    s = particles_l(spark, d).s.select(Annulus(40.0, 100.0))
    return spark.createDataFrame([(i, q.value) for i, q in enumerate([*s.topk("temp", 5), *s.topk("temp", -3)])], "place int, temp double")


def physical(spark: SparkSession, d: str) -> DataFrame:
    s = with_units(spark, d).physical_units(distance="pc", velocity="km s^-1", mass="Msol")
    return rounded(s.df.agg(F.max("x").alias("x"), F.min("vy").alias("vy"), F.sum("mass").alias("mass")), 4)


def density_in_sphere(spark: SparkSession, d: str) -> DataFrame:
    """Mass in a filter's volume: the filter gives both."""
    s, f = particles_l(spark, d), Sphere(25.0)
    return s.where(f.mask(s)).df.agg(F.round(F.sum("mass") / f.volume(s) * 1e6, 4).alias("density"))


add("snapshot_reductions", reductions, f"{P} SELECT round(min(temp), 3) AS min, round(max(temp), 3) AS max, round(avg(temp), 3) AS mean, round(stddev_pop(temp), 3) AS std, round(quantile_cont(temp, 0.5), 3) AS median, round(max(temp) - min(temp), 3) AS ptp FROM q")
add("snapshot_topk", largest, f"""{P}, s AS (SELECT temp, row_number() OVER (ORDER BY temp DESC) AS hi, row_number() OVER (ORDER BY temp) AS lo FROM q WHERE family = 'star' AND r >= 40 AND r < 100)
SELECT CAST(CASE WHEN hi <= 5 THEN hi - 1 ELSE lo + 4 END AS INTEGER) AS place, temp FROM s WHERE hi <= 5 OR lo <= 3""")
add("snapshot_cumsum", lambda spark, d: particles_l(spark, d).cumsum("mass", "x"), f"{P} SELECT x AS key, sum(sum(mass)) OVER (ORDER BY x) AS total FROM q GROUP BY x")
add("snapshot_physical_units", physical, f"{P} SELECT 1000 * max(x) AS x, min(vy) AS vy, sum(mass) AS mass FROM q")
add("filter_volume", density_in_sphere, f"{P} SELECT round(sum(mass) / (4.0/3.0*pi()*pow(25, 3)) * 1e6, 4) AS density FROM q WHERE r < 25")

# --- sources: written, read back and summed
def stored(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        top, s = spark.conf.get("spark.checkpoint.dir", None), particles_e(spark, d)
        if not top:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="orrery-sources-")
            atexit.register(shutil.rmtree, top, ignore_errors=True)
        path = f"{top.rstrip('/')}/orrery_{kind}_{uuid.uuid4().hex}"
        if kind == "gadget":
            write_gadget(s, path, files=3)
            back = read_gadget(spark, path, columns=["x", "vy", "mass"], chunk=500)
        else:
            write_snapshot(s, path)
            back = read_snapshot(spark, path)
        return rounded(back.where(F.col("family") != "gas").df.groupBy("family").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("x", "vy", "mass")]), 4)

    return run


for _kind in ("gadget", "parquet"):
    add(f"source_{_kind}", stored(_kind), f"{EP} SELECT family, count(*) AS n, round(sum(x), 4) AS x, round(sum(vy), 4) AS vy, round(sum(mass), 4) AS mass FROM e WHERE family <> 'gas' GROUP BY family")

# --- gravity
_R2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
_POINTS = "pts AS (SELECT CAST(i AS BIGINT) AS pid, -15.0 + 3.0 * i AS x, 2.0 - i AS y, 0.5 * i AS z FROM range(11) AS t(i))"


def points(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("double")
    return spark.range(11).select(F.col("id").alias("pid"), (-15.0 + 3.0 * i).alias("x"), (2.0 - i).alias("y"), (0.5 * i).alias("z"))


def _spline(h: str) -> str:
    u = f"(sqrt({_R2})/{h})"
    near = f"(16.0/3*pow({u},2) - 48.0/5*pow({u},4) + 32.0/5*pow({u},5) - 14.0/5)/{h}"
    far = f"(1/(15*{u}) + 32.0/3*pow({u},2) - 16*pow({u},3) + 48.0/5*pow({u},4) - 32.0/15*pow({u},5) - 16.0/5)/{h}"
    return f"CASE WHEN {u} < 0.5 THEN {near} WHEN {u} < 1 THEN {far} ELSE -1/sqrt({_R2}) END"


def _spline_force(h: str) -> str:
    r, u = f"sqrt({_R2})", f"(sqrt({_R2})/{h})"
    near = f"(32.0/3*{u} - 192.0/5*pow({u},3) + 32.0*pow({u},4))/({h}*{h}*{r})"
    far = f"(-1/(15*{u}*{u}) + 64.0/3*{u} - 48*pow({u},2) + 192.0/5*pow({u},3) - 32.0/3*pow({u},4))/({h}*{h}*{r})"
    return f"CASE WHEN {u} < 0.5 THEN {near} WHEN {u} < 1 THEN {far} ELSE 1/pow({r}, 3) END"


_PAIR = "FROM e a JOIN e b ON a.pid <> b.pid GROUP BY a.pid"
_ACC = ", ".join(f"round(sum(b.mass*(b.{c}-a.{c})/pow(sqrt({_R2}), 3)), 5) AS a{c}" for c in "xyz")
_DIRECT_PHI = f"{EP} SELECT a.pid AS pid, round(-sum(b.mass/sqrt({_R2})), 5) AS phi {_PAIR}"
_DIRECT_ACC = f"{EP} SELECT a.pid AS pid, {_ACC} {_PAIR}"


def gravity(method: str, what: tuple[str, ...], at_points: bool = False, **options) -> Query:
    return lambda spark, d: rounded(getattr(Gravity(particles_e(spark, d), **options), method)(points(spark) if at_points else None, what), 5)


_A = ("ax", "ay", "az")
add("gravity_direct_pot", gravity("direct", ("phi",)), _DIRECT_PHI)
add("gravity_direct_acc", gravity("direct", _A), _DIRECT_ACC)
add("gravity_points_pot", gravity("direct", ("phi",), True), f"{EP}, {_POINTS} SELECT a.pid AS pid, round(-sum(b.mass/sqrt({_R2})), 5) AS phi FROM pts a CROSS JOIN e b GROUP BY a.pid")
add("gravity_points_acc", gravity("direct", _A, True), f"{EP}, {_POINTS} SELECT a.pid AS pid, {_ACC} FROM pts a CROSS JOIN e b GROUP BY a.pid")
add("gravity_plummer_pot", gravity("direct", ("phi",), softening="eps", kernel="plummer"), f"{EP} SELECT a.pid AS pid, round(-sum(b.mass/sqrt({_R2} + pow(greatest(a.eps, b.eps), 2))), 5) AS phi {_PAIR}")
add("gravity_plummer_acc", gravity("direct", _A, softening=0.5, kernel="plummer"), f"{EP} SELECT a.pid AS pid, " + ", ".join(f"round(sum(b.mass*(b.{c}-a.{c})/pow({_R2} + 0.25, 1.5)), 5) AS a{c}" for c in "xyz") + f" {_PAIR}")
add("gravity_spline_pot", gravity("direct", ("phi",), softening=2.0, kernel="spline"), f"{EP} SELECT a.pid AS pid, round(sum(b.mass*({_spline('2.0')})), 5) AS phi {_PAIR}")
add("gravity_spline_acc", gravity("direct", _A, softening=2.0, kernel="spline"), f"{EP} SELECT a.pid AS pid, " + ", ".join(f"round(sum(b.mass*(b.{c}-a.{c})*({_spline_force('2.0')})), 5) AS a{c}" for c in "xyz") + f" {_PAIR}")
add("gravity_tree_theta0", gravity("tree", ("phi",), theta=0.0), _DIRECT_PHI)
add("gravity_tree_theta0_acc", gravity("tree", _A, theta=0.0), _DIRECT_ACC)
add("gravity_tree_plummer0", gravity("tree", ("phi",), theta=0.0, softening="eps", kernel="plummer"), ORACLE_SQL["gravity_plummer_pot"])
add("gravity_tree_order3", gravity("tree", ("phi", *_A), theta=0.7, multipole_order=3))
add("gravity_tree_order5", gravity("tree", ("phi", *_A), theta=0.7, multipole_order=5))


def of_cells(method_points: bool, what: tuple[str, ...], **options) -> Query:
    return gravity("tree", what, method_points, cell=60, **options)


add("gravity_cells_theta0", of_cells(False, ("phi",), theta=0.0), _DIRECT_PHI)
add("gravity_cells_theta0_acc", of_cells(False, _A, theta=0.0), _DIRECT_ACC)
add("gravity_cells_spline0_acc", of_cells(False, _A, theta=0.0, softening=2.0, kernel="spline"), ORACLE_SQL["gravity_spline_acc"])
add("gravity_cells_points0", of_cells(True, ("phi",), theta=0.0), ORACLE_SQL["gravity_points_pot"])
add("gravity_tree_points0", gravity("tree", ("phi",), True, theta=0.0), ORACLE_SQL["gravity_points_pot"])
add("gravity_tree_points0_acc", gravity("tree", _A, True, theta=0.0), ORACLE_SQL["gravity_points_acc"])
add("gravity_plummer_points_pot", gravity("direct", ("phi",), True, softening="eps", kernel="plummer"), f"{EP}, {_POINTS} SELECT a.pid AS pid, round(-sum(b.mass/sqrt({_R2} + b.eps*b.eps)), 5) AS phi FROM pts a CROSS JOIN e b GROUP BY a.pid")
add("gravity_plummer_points_acc", gravity("direct", _A, True, softening="eps", kernel="plummer"), f"{EP}, {_POINTS} SELECT a.pid AS pid, " + ", ".join(f"round(sum(b.mass*(b.{c}-a.{c})/pow({_R2} + b.eps*b.eps, 1.5)), 5) AS a{c}" for c in "xyz") + " FROM pts a CROSS JOIN e b GROUP BY a.pid")
add("calculate_potential", lambda spark, d: rounded(calculate_potential(particles_e(spark, d), method="direct"), 5), _DIRECT_PHI)
add("calculate_acceleration", lambda spark, d: rounded(calculate_acceleration(particles_e(spark, d), points(spark), method="direct"), 5), ORACLE_SQL["gravity_points_acc"])
add("calculate_potential_tree", lambda spark, d: rounded(calculate_potential(particles_e(spark, d), softening="eps", kernel="plummer", theta=0.0), 5), ORACLE_SQL["gravity_plummer_pot"])


def tree_error(order: int, phi: float, acc: float, **options) -> Query:
    """Whether the tree is near the direct sums: the potential, and the acceleration against the median one."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        g = Gravity(particles_e(spark, d), theta=0.7, multipole_order=order, **options)
        both = g.tree(None).join(g.direct(None).toDF("pid", *[f"{c}_d" for c in ("phi", *_A)]), "pid")
        off = F.sqrt(sum((F.col(c) - F.col(f"{c}_d")) ** 2 for c in _A))
        size = F.sqrt(sum(F.col(f"{c}_d") ** 2 for c in _A))
        return both.select("pid", (F.abs(F.col("phi") - F.col("phi_d")) <= phi * F.abs("phi_d")).alias("near_phi"), (off <= acc * F.greatest(size, F.lit(1.0))).alias("near_acc"))

    return run


for _order, _phi, _acc in ((0, 0.02, 0.2), (3, 0.002, 0.05), (5, 0.001, 0.02)):
    add(f"gravity_tree_order{_order}_error", tree_error(_order, _phi, _acc), f"{EP} SELECT pid, true AS near_phi, true AS near_acc FROM e")
add("gravity_cells_order3_error", tree_error(3, 0.002, 0.05, cell=60), ORACLE_SQL["gravity_tree_order3_error"])
add("gravity_cells_order5_error", tree_error(5, 0.001, 0.02, cell=60), ORACLE_SQL["gravity_tree_order3_error"])
