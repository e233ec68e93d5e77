"""Profiles: statistics of particles by bin.

All statistics that are asked for together are one ``groupBy(bin).agg``; percentiles, of any
number of fields and shares, take two passes more, and order a small part of each bin. Bins without particles are NaN in every statistic, and 0 in ``npart``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import divide
from ..plans.core import Calculator
from ..snapshot import Snapshot
from .bins import BinsSet, Edges
from .filters import FamilyFilter, Filter
from .partials import PARTIALS, folded
from .quantiles import Rank, percentiles

NAN = float("nan")
#: Statistic: ``fn(x, w) -> aggregate Column``; w is None without a weight.
STATISTICS: dict[str, Callable[[Column, Column | None], Column]] = {}
PROPERTIES: dict[str, dict[str, Callable[[Profile], Column]]] = {"profile": {}, "radial": {}, "age": {}}


def statistic(name: str):
    return lambda fn: STATISTICS.setdefault(name, fn)


def profile_property(name: str, kind: str = "profile"):
    """Register ``fn(stat) -> Column`` as a field of profiles; ``stat(field, statistic)`` is a column of the binned frame."""
    return lambda fn: PROPERTIES[kind].setdefault(name, fn)


@statistic("mean")
def mean(x: Column, w: Column | None) -> Column:
    return F.avg(x) if w is None else divide(F.sum(x * w), F.sum(w))


statistic("sum")(lambda x, w: F.sum(x))
statistic("sum_w")(lambda x, w: F.sum(x) if w is None else F.sum(x * w))


@statistic("rms")
def rms(x: Column, w: Column | None) -> Column:
    return F.sqrt(mean(x * x, w))


@statistic("disp")
def disp(x: Column, w: Column | None) -> Column:
    var = mean(x * x, w) - mean(x, w) * mean(x, w)
    return F.when(var >= 0, F.sqrt(F.abs(var))).when(var > -1e-12, 0.0).otherwise(NAN)


def canonical(stat: str) -> str:
    s = stat.lower()
    if s.startswith("abs"):
        rest = s[3:].lstrip("_")
        return "abs_" + canonical(rest or "mean")
    s = {"median": "p50", "med": "p50", "dispersion": "disp"}.get(s, s)
    if re.fullmatch(r"p\d{1,3}", s):
        if int(s[1:]) > 100:
            raise ValueError(f"no percentile {stat}")
        return f"p{int(s[1:])}"
    if s not in STATISTICS and (s not in PARTIALS or PARTIALS[s].many):
        raise ValueError(f"no statistic {stat!r}: {[*STATISTICS, *PARTIALS, 'pNN', 'med', 'abs_<statistic>']}")
    return s


def known(stat: str) -> bool:
    try:
        return bool(canonical(stat))
    except ValueError:
        return False


@dataclass(frozen=True)
class Profile:
    """Bins of a snapshot. ``pr["mass"]["sum"]``, ``pr["mass_sum"]`` and ``pr["density"]`` are arrays; ``pr.table(...)`` is the frame they come from."""

    snap: Snapshot
    edges: Edges
    key: Any
    weight: Any = None
    kind: str = "profile"
    parent: Profile | None = None
    cache: dict[str, np.ndarray] = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, snap: Snapshot, weight: Any = None, kind: str = "profile", **bins: Any) -> Profile:
        b = BinsSet(**bins)
        return cls(snap, b(snap), b.key, weight, kind)

    # frames
    def binned(self) -> DataFrame:
        """The particles that are in a bin, with ``bin``."""
        return self.snap.df.withColumn("bin", self.edges.assign(self.key(self.snap).cast("double"))).where("bin is not null")

    def _weight(self) -> Column | None:
        if self.weight is None or isinstance(self.weight, Column):
            return self.weight
        return self.weight(self.snap) if callable(self.weight) else self.snap.field(self.weight)

    def _needs(self, name: str) -> list[tuple[str, str]]:
        """(field, statistic) pairs of a field, a field with a statistic, or a property."""
        got: list[tuple[str, str]] = []
        prop = self.property_of(name)
        if prop is None:
            return [self.parse(name)]
        prop(lambda f, s="mean": (got.append((f, canonical(s))), F.lit(0.0))[1])
        return got

    def property_of(self, name: str):
        for kind in dict.fromkeys((self.kind, "profile")):
            if name in PROPERTIES[kind]:
                return PROPERTIES[kind][name]
        return None

    def parse(self, name: str) -> tuple[str, str]:
        """A field and a statistic; the last ``_`` that leaves both is taken. Without one, the mean."""
        at = [m.start() for m in re.finditer("_", name)][::-1]
        for i in at:
            if known(name[i + 1 :]) and not known(name[:i]):
                head, stat = name[:i], name[i + 1 :]
                if head.endswith("_abs") or (j := head.rfind("_abs_")) > 0 and known(head[j + 1 :] + "_" + stat):
                    j = head.rfind("_abs")
                    return head[:j], canonical(head[j + 1 :] + "_" + stat)
                if stat == "w" or not head:
                    continue
                return head, canonical(stat)
        if name.endswith("_sum_w"):
            return name[: -len("_sum_w")], "sum_w"
        return name, "mean"

    def table(self, *names: str) -> DataFrame:
        """``bin, left, right, center, dr, size, npart`` and a column for each name, a row for each bin, in no order."""
        needs = list(dict.fromkeys(p for n in names for p in self._needs(n)))
        rows, w = self.binned(), self._weight()
        fields = {f: self.snap.field(f).cast("double") for f, _ in needs}
        place = {f: f"_f{i}" for i, f in enumerate(fields)}
        rows = rows.select("bin", *[c.alias(place[f]) for f, c in fields.items()], *([w.cast("double").alias("_w")] if w is not None else []))
        weight = F.col("_w") if w is not None else None
        out: dict[tuple[str, str], str] = {}
        aggs, framed, users = [F.count(F.lit(1)).alias("npart")], [], []
        for i, (f, s) in enumerate(needs):
            out[f, s] = name = f"_s{i}"
            x, stat = F.col(place[f]), s
            while stat.startswith("abs_"):
                x, stat = F.abs(x), stat[4:]
            if stat in PARTIALS:
                users.append((x, PARTIALS[stat], name))
            elif not re.fullmatch(r"p\d+", stat):
                aggs.append(STATISTICS[stat](x, weight).alias(name))
            else:
                framed.append((x, int(stat[1:]) / 100, name))
        frame = rows.groupBy("bin").agg(*aggs)
        if framed:
            values = list(dict.fromkeys(str(x) for x, _, _ in framed))
            ranks = [Rank(values.index(str(x)), p) for x, p, _ in framed]
            columns = [next(x for x, _, _ in framed if str(x) == v) for v in values]
            found = percentiles(rows, F.col("bin"), columns, ranks, weight, self.edges.nbins).toDF("bin", *[n for _, _, n in framed])
            frame = frame.join(F.broadcast(found), "bin", "left")
        for x, partial, name in users:
            frame = frame.join(F.broadcast(folded(rows, F.col("bin"), x, partial, weight).select(F.col("g").cast("int").alias("bin"), F.col("value").alias(name))), "bin", "left")
        # One row a bin: the frame is small by construction.
        full = self.edges.table(self.snap.df.sparkSession).join(F.broadcast(frame), "bin", "left").withColumn("npart", F.coalesce("npart", F.lit(0)))
        full = full.withColumns({n: F.coalesce(F.col(n), F.lit(NAN)) for n in out.values()})
        stat = lambda f, s="mean": F.col(out[f, canonical(s)])
        columns = []
        for n in names:
            prop = self.property_of(n)
            columns.append((prop(stat) if prop else F.col(out[self.parse(n)])).alias(n))
        return full.select("bin", "left", "right", "center", "dr", "size", "npart", *columns)

    # arrays
    def array(self, name: str) -> np.ndarray:
        if name not in self.cache:
            self.cache.update(self.arrays(name))
        return self.cache[name]

    def arrays(self, *names: str) -> dict[str, np.ndarray]:
        """Several at once, in one job."""
        rows = self.table(*names).orderBy("bin").collect()
        return {n: np.array([r[n] for r in rows], float) for n in names}

    def __getitem__(self, name: Any) -> Any:
        if isinstance(name, Filter):
            return self.part(name)
        if name in ("rbins", "dr", "binsize", "npart_bins", "rbins_edges"):
            return getattr(self, name)
        return FieldView(self, name)

    def part(self, f: Filter) -> Profile:
        """The same bins over a part of the particles."""
        return replace(self, snap=self.snap.where(f.mask(self.snap)), parent=self.parent or self, cache={})

    def __getattr__(self, name: str) -> Profile:
        if name in ("s", "g", "dm"):
            return self.part(FamilyFilter(name))
        raise AttributeError(name)

    def particles_at_bin(self, which: int | slice | Iterable[int]) -> DataFrame:
        n = self.edges.nbins
        if isinstance(which, int):
            bins = [which % n]
        elif isinstance(which, slice):
            bins = list(range(n))[which]
        else:
            which = list(which)
            bins = [i for i, on in enumerate(which) if on] if which and all(isinstance(v, bool) for v in which) else which
        return self.binned().where(F.col("bin").isin(bins))

    @property
    def rbins(self) -> np.ndarray:
        return self.edges.centers

    @property
    def rbins_edges(self) -> np.ndarray:
        return self.edges.edges

    @property
    def dr(self) -> np.ndarray:
        return self.edges.dr

    @property
    def binsize(self) -> np.ndarray:
        return self.edges.size

    @property
    def npart_bins(self) -> np.ndarray:
        return self.array("npart_bins")

    def keys(self) -> list[str]:
        return self.snap.keys()

    def property_keys(self) -> list[str]:
        return sorted({*PROPERTIES["profile"], *PROPERTIES[self.kind]})

    def all_keys(self) -> list[str]:
        return sorted({*self.snap.all_keys(), *self.property_keys()})

    def plot(self, y: str, x: str = "rbins", **options: Any) -> Any:
        """A line, if matplotlib is there."""
        import matplotlib.pyplot as plt

        return plt.plot(getattr(self, x) if hasattr(type(self), x) else self.array(x), self.array(y), **options)


@dataclass(frozen=True)
class FieldView:
    """``pr["mass"]``: the mean by bin as an array, and any other statistic by name."""

    profile: Profile
    name: str

    def __array__(self, dtype: Any = None, copy: Any = None) -> np.ndarray:
        return self.profile.array(self.name)

    def __getitem__(self, key: Any) -> Any:
        if not isinstance(key, str):
            return self.profile.array(self.name)[key]
        if self.profile.property_of(self.name) is not None:
            raise RuntimeError(f"{self.name} is made of bins and has no statistics")
        return self.profile.array(f"{self.name}_{canonical(key)}")

    def __len__(self) -> int:
        return self.profile.edges.nbins


PROPERTIES["profile"]["npart_bins"] = lambda stat: F.col("npart").cast("double")


@profile_property("density", "radial")
def density(stat) -> Column:
    return divide(stat("mass", "sum"), F.col("size"))


@profile_property("mass_enc", "radial")
def mass_enc(stat) -> Column:
    """A running sum: NaN from the first empty bin on."""
    return F.sum(stat("mass", "sum")).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))


@profile_property("beta", "radial")
def beta(stat) -> Column:
    """Anisotropy of velocities."""
    a, b, c = stat("vphi", "rms"), stat("vtheta", "rms"), stat("vr", "rms")
    return 1 - divide(a * a + b * b, 2 * c * c)


@profile_property("sfr", "age")
def sfr(stat) -> Column:
    return divide(stat("mass", "sum"), F.col("size"))


def RadialProfile(snap: Snapshot, ndim: int = 3, weight: Any = None, **bins: Any) -> Profile:
    if ndim not in (2, 3):
        raise ValueError("ndim is 2 or 3")
    preset = {"bins_by": "r", "bins_area": "spherical_shell"} if ndim == 3 else {"bins_by": "rxy", "bins_area": "annulus"}
    return Profile.of(snap, weight, "radial", **preset | bins)


def StarAgeProfile(snap: Snapshot, weight: Any = "mass", **bins: Any) -> Profile:
    stars = snap.family("star")
    if stars.df.isEmpty():
        raise ValueError("no stars")
    return Profile.of(stars, weight, "age", **{"bins_by": "age", "bins_area": "length"} | bins)


class ProfileBuilder(Calculator):
    """A calculator whose value is a profile; bounds of the bins may be calculators."""

    def __init__(self, build: Callable[..., Profile], **options: Any):
        self.build, self.options = build, options

    def profile(self, snap: Snapshot) -> Profile:
        return self.build(snap, **self.options)

    def frame(self, snap: Snapshot) -> DataFrame:
        return self.profile(snap).table()

    def run(self, snap: Snapshot, options: Any = None) -> Any:
        from ..plans.result import Result

        return Result(self.label(), self.profile(snap), self.signature_hash())

    def signature(self) -> Any:
        from ..plans.core import signature_of

        return ("ProfileBuilder", self.build.__name__, signature_of(self.options))


def RadialProfileBuilder(ndim: int = 3, weight: Any = None, **bins: Any) -> ProfileBuilder:
    return ProfileBuilder(RadialProfile, ndim=ndim, weight=weight, **bins)
