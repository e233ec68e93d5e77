"""Gravity: direct sums and a Barnes-Hut octree, for all particles or at given points.

Direct sums take blocks of targets and sources in Arrow batches. Sources are broadcast up to a
checked number. Beyond it particles are dealt into blocks, each unordered pair of blocks meets
once for the sums of both sides, and partial sums are added; points meet every block.

The octree is built in tasks. Passes of counts cut space into domains, nodes of the octree of
at most ``cell`` particles; a task builds the linear octree of each and rolls its moments up.
What comes to the driver is a row for each domain, of which the tree above them is made and
broadcast. Targets are dealt into blocks by domain. A block's box walks the tree above to find
the domains it has to look into, each of those sends the part of its tree that the box can
reach, and a task then walks all of it for the block's targets. Each target sees the nodes
that it would see in one tree over all particles.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..snapshot import Snapshot
from ..units import gravity_constant, in_units
from .domains import FIRST, STEP, Domains, dealt, needed, settle, summary, walk
from .tree import DEPTH, Tree, codes

#: Sources up to this number (some 50 bytes each) are broadcast whole.
BROADCAST_SOURCES = 20_000
BLOCK = 20_000
#: A block takes the targets of several domains up to this number under any angle: a task has to be worth its exchange.
FEWEST = 400
#: Below this angle blocks of targets grow, by its third power.
WIDE = 0.7
#: Sources that come together in a task for a block of targets; beyond it they come in several, whose sums are added.
SLICE = 100_000
#: Domains in all: beyond it they hold more than ``cell`` particles, so that what is above them stays small.
MOST_DOMAINS = 100_000
#: Bundles of domains a core.
PER_CORE = 4
#: Blocks of targets in a domain.
CHUNKS = 2**20
#: A target walks again if its net acceleration is below this share of the pulls of far nodes, for ``ANGLES`` in turn (shares of ``theta``; the bound goes with their square, as the errors do at least).
CANCEL = 0.05
ANGLES = (1.0, 1 / 3, 0.0)
KERNELS = ("newton", "plummer", "spline")
SUMS = ("phi", "ax", "ay", "az")


@dataclass(frozen=True)
class Gravity:
    """``softening``: None, a number, or the name of a column."""

    snap: Snapshot
    softening: Any = None
    kernel: str | None = None
    theta: float = 0.7
    leaf_capacity: int = 8
    multipole_order: int = 3
    g: float = 1.0
    cell: int = 20_000

    def __post_init__(self) -> None:
        if self.softening is not None and self.kernel in (None, "newton"):
            raise ValueError("softening needs a kernel: plummer or spline")
        if self.kernel is not None and self.kernel not in KERNELS:
            raise ValueError(f"kernel {self.kernel!r} is none of {KERNELS}")
        if not 0 <= self.multipole_order <= 5:
            raise ValueError("orders are 0 to 5")

    @property
    def kind(self) -> str:
        return self.kernel or "newton"

    def _h(self, snap: Snapshot) -> Column:
        if self.softening is None:
            return F.lit(0.0)
        if isinstance(self.softening, str) and self.softening in snap.df.columns:
            return F.col(self.softening).cast("double")
        return F.lit(in_units(self.softening, snap.unit_of("pos")))

    def sources(self) -> DataFrame:
        s = self.snap
        return s.df.select(F.col("pid").alias("sid"), *[c.cast("double").alias(f"s{n}") for c, n in zip(s.vector("pos"), "xyz", strict=True)], s.field("mass").cast("double").alias("sm"), self._h(s).alias("sh"))

    def _targets(self, points: DataFrame | None) -> DataFrame:
        if points is not None:
            return points.select("pid", *[F.col(c).cast("double").alias(f"t{c}") for c in "xyz"], F.lit(0.0).alias("th"))
        s = self.snap
        return s.df.select("pid", *[c.cast("double").alias(f"t{n}") for c, n in zip(s.vector("pos"), "xyz", strict=True)], self._h(s).alias("th"))

    def direct(self, points: DataFrame | None = None, sums: Sequence[str] = SUMS) -> DataFrame:
        """``pid`` and ``sums``: ``phi, ax, ay, az`` or some of them, and only these are computed. A particle does not act on itself; at points nothing is left out."""
        give = _Given(self.g, sums)
        targets, sources = self._targets(points), self.sources()
        s = sources.limit(BROADCAST_SOURCES + 1).toPandas()
        if len(s) > BROADCAST_SOURCES:
            return self._direct_mutual(sources, give) if points is None else self._direct_blocks(targets, sources, give)
        shared = self.snap.df.sparkSession.sparkContext.broadcast((s[["sx", "sy", "sz"]].to_numpy(), s["sm"].to_numpy(), s["sh"].to_numpy(), s["sid"].to_numpy()))
        kind, soft, own = self.kind, self.softening is not None, points is None
        ship(self.snap.df.sparkSession)

        def act(batches):
            from .tree import pair_sums

            pos, m, h, sid = shared.value
            for t in batches:
                phi, acc = pair_sums(t[["tx", "ty", "tz"]].to_numpy(), t["th"].to_numpy(), pos, m, h, kind, soft, own, t["pid"].to_numpy() if own else None, sid, *give.what)
                yield give(t["pid"], phi, acc)

        return targets.mapInPandas(act, give.schema)

    def _direct_mutual(self, particles: DataFrame, give: _Given) -> DataFrame:
        """Each unordered pair of blocks meets once, in a task, and gives the sums of both sides.

        A row goes to a pair with each block, so there is a copy of it for each block, not two, and
        each kernel value serves both particles. Rows of one id are in one block.
        """
        spark = self.snap.df.sparkSession
        # Some sixteen pairs a core, however few the particles: hashing deals pairs to partitions unevenly.
        n = max(-(-particles.count() // BLOCK), math.isqrt(32 * spark.sparkContext.defaultParallelism) + 1)
        kind, soft = self.kind, self.softening is not None
        ship(spark)

        def meet(s: pd.DataFrame) -> pd.DataFrame:
            from .tree import mutual_sums, own_sums

            one, other = ((r["sid"].to_numpy(), r[["sx", "sy", "sz"]].to_numpy(), r["sh"].to_numpy(), r["sm"].to_numpy()) for r in (s[~s["second"]], s[s["second"]]))
            if s["i"].iloc[0] == s["j"].iloc[0]:
                ids, (phi, acc) = one[0], own_sums(*one[1:], one[0], kind, soft, *give.what)
            else:
                phis, accs = mutual_sums(*one[1:], *other[1:], kind, soft, *give.what)
                ids, phi, acc = np.concatenate([one[0], other[0]]), np.concatenate(phis), np.concatenate(accs)
            return give(ids, phi, acc)

        # As many partitions as there may be tasks: the few bytes of a pair say nothing of its work.
        parts = min(n * (n + 1) // 2, 16 * spark.sparkContext.defaultParallelism)
        return _added(_paired(particles, n).repartition(parts, "i", "j").groupBy("i", "j").applyInPandas(meet, give.schema))

    def _direct_blocks(self, targets: DataFrame, sources: DataFrame, give: _Given) -> DataFrame:
        """Each block of sources meets each block of points in a task of bounded memory."""
        n = max(1, -(-sources.count() // BLOCK))
        m = max(1, -(-targets.count() // BLOCK))
        kind, soft = self.kind, self.softening is not None
        ship(self.snap.df.sparkSession)
        left = targets.withColumn("i", F.pmod(F.xxhash64("pid"), F.lit(m)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        right = sources.withColumn("j", F.pmod(F.xxhash64("sid"), F.lit(n)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

        def meet(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            from .tree import pair_sums

            phi, acc = pair_sums(t[["tx", "ty", "tz"]].to_numpy(), t["th"].to_numpy(), s[["sx", "sy", "sz"]].to_numpy(), s["sm"].to_numpy(), s["sh"].to_numpy(), kind, soft, False, None, None, *give.what)
            return give(t["pid"], phi, acc)

        return _added(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, give.schema))

    @cached_property
    def forest(self) -> Forest:
        """The octree, built once for all calls on this object; its domains' trees are persisted."""
        sources = self.sources()
        spark = self.snap.df.sparkSession
        ship(spark)
        n, *ends = sources.agg(F.count("*"), *[f(f"s{c}") for f in (F.min, F.max) for c in "xyz"]).first()
        if not n:
            raise ValueError("no particles to build a tree of")
        low, high = np.array(ends, float).reshape(2, 3)
        if not np.isfinite([low, high]).all():
            raise ValueError("positions have to be numbers")
        cube = 0.5 * (low + high), max(0.5 * float((high - low).max()), 1e-6)
        domains = self._domains(sources, n, cube)
        soft, leaf, order, kind = self.softening is not None, self.leaf_capacity, self.multipole_order, self.kind

        # Small domains on end are built, and later sent, by one call: a bundle holds some BLOCK particles at most, for few of them less.
        cells = len(domains.start)
        bundles = min(cells, max(PER_CORE * spark.sparkContext.defaultParallelism, -(-n // BLOCK)))

        def place(batches):
            for s in batches:
                domain = domains.of_points(s[["sx", "sy", "sz"]].to_numpy())
                yield s.assign(domain=domain, bundle=domain * bundles // cells)

        def build(s: pd.DataFrame) -> pd.DataFrame:
            made = []
            for d, rows in s.sort_values("sid").groupby("domain"):
                tree = Tree.build(rows[["sx", "sy", "sz"]].to_numpy(), rows["sm"].to_numpy(), rows["sh"].to_numpy() if soft else None, rows["sid"].to_numpy(), cube=cube, depth=int(domains.depth[d]), leaf_capacity=leaf, order=order, kernel=kind)
                made.append({"bundle": s["bundle"].iloc[0], "domain": d, **summary(tree), "tree": pickle.dumps(tree, 5)})
            return pd.DataFrame(made)

        placed = sources.mapInPandas(place, "sid long, sx double, sy double, sz double, sm double, sh double, domain long, bundle long")
        root = "bundle long, domain long, n long, inner boolean, total double, com array<double>, hmax double, moments array<double>"
        trees = placed.repartition(bundles, "bundle").groupBy("bundle").applyInPandas(build, f"{root}, tree binary").persist()
        roots = {r["domain"]: r.asDict() for r in trees.drop("bundle", "tree").collect()}  # MOST_DOMAINS rows
        top, domain = domains.top([roots[i] for i in range(len(domains.start))], order, kind, soft)
        held = {i: r["n"] for i, r in roots.items()}
        slice_of = np.cumsum([0] + [held[i] for i in range(len(held) - 1)]) * -(-n // SLICE) // n
        return Forest(domains, trees, top, domain, held, n, slice_of, bundles)

    def release(self) -> None:
        """Give the persisted trees and sums up; they are made anew when needed."""
        for out in self.__dict__.pop("walked", []):
            out.unpersist()
        if "forest" in self.__dict__:
            self.__dict__.pop("forest").trees.unpersist()

    def _domains(self, sources: DataFrame, n: int, cube: tuple[np.ndarray, float]) -> Domains:
        """Nodes of at most ``cell`` sources whose parents hold more. Counts come from passes over the sources; what is collected is bounded by the number of domains."""
        limit = max(self.cell, self.leaf_capacity, -(-n // MOST_DOMAINS))
        if n <= limit:
            return Domains.of(cube, [(0, 0)])
        found, big, top, depth = [], None, 0, FIRST
        while True:
            wanted = None if big is None else np.array(sorted(big), np.int64)

            def count(batches, wanted=wanted, top=top, depth=depth):
                for s in batches:
                    at = codes(s[["sx", "sy", "sz"]].to_numpy(), *cube) >> 3 * (DEPTH - depth)
                    if wanted is not None:
                        at = at[np.isin(at >> 3 * (depth - top), wanted)]
                    cell, held = np.unique(at, return_counts=True)
                    yield pd.DataFrame({"at": cell, "n": held.astype(np.int64)})

            counts = sources.mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
            more, big = settle({r["at"]: r["n"] for r in counts}, depth, top, limit)
            found += more
            if not big or depth >= DEPTH:
                return Domains.of(cube, found + [(depth, c) for c in big])
            top, depth = depth, min(depth + STEP, DEPTH)

    def tree(self, points: DataFrame | None = None, sums: Sequence[str] = SUMS) -> DataFrame:
        """The same by the tree: nodes seen under an angle below ``theta`` act through their moments.

        The errors of far nodes go with their pulls. Where these cancel to a net acceleration below ``CANCEL`` of
        their sum, little of it may be right: such targets walk again under a smaller angle, and what
        still cancels too far for that angle meets every particle.
        """
        _Given(self.g, sums)
        targets, own = self._targets(points), points is None
        if self.theta <= 0 or set(sums) <= {"phi"}:
            return self._walked(targets, own, self.theta, sums)
        done, wanted = [], tuple(c for c in SUMS if c in sums or c != "phi")
        for k, part in enumerate(ANGLES):
            out = self._walked(targets, own, self.theta * part, wanted if part <= 0 else (*wanted, "pull"), k > 0)
            if part > 0:
                self.__dict__.setdefault("walked", []).append(out.persist())
                net = F.sqrt(sum(F.col(c) ** 2 for c in SUMS[1:]))
                few = out.where(net < CANCEL * part * part * F.col("pull")).select("pid").distinct()
                if few.isEmpty():
                    few = None
                else:
                    targets = targets.join(few, "pid", "left_semi")
                    out = out.join(few, "pid", "left_anti")
            done.append(out.select("pid", *sums))
            if part <= 0 or few is None:
                return reduce(DataFrame.unionAll, done)
        raise AssertionError("the last angle is 0")

    def _walked(self, targets: DataFrame, own: bool, theta: float, sums: Sequence[str], again: bool = False) -> DataFrame:
        """``pid`` and ``sums`` by one walk; ``pull``: how much far nodes pull in all."""
        give = _Given(self.g, sums)
        placed, pairs, exchanged, shared, blocks = self._asked(targets, own, theta, again)
        at = ["block"]
        if self.forest.slices > 1:
            at = ["block", "slice"]
            # Of the pairs, not of what is sent: that would be made twice.
            wanted = pairs.select("block", "slice").unionAll(placed.select("block", F.lit(-1).cast("long").alias("slice"))).distinct().toDF("_block", "_slice")
            placed = placed.join(wanted, F.col("block") == F.col("_block")).withColumn("slice", F.col("_slice") + 0).drop("_block", "_slice")
        # The few bytes of a block say nothing of its work: its task is not to be joined with others.
        tasks = max(1, min(blocks * (1 if len(at) == 1 else self.forest.slices + 1), 16 * self.snap.df.sparkSession.sparkContext.defaultParallelism))

        def act(t: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            if not len(t):
                return pd.DataFrame({c: [] for c in ("pid", *give.sums)})
            top, domain = shared.value
            parts, whole = {}, {}
            for d, everything, b in zip(sent["domain"], sent["whole"], sent["part"], strict=True):
                if everything:
                    whole[int(d)] = np.frombuffer(b).reshape(-1, 6)
                else:
                    parts[int(d)] = pickle.loads(b)
            # Of several slices the one without parts gives what is above them.
            above = len(at) == 1 or bool((t["slice"] == -1).iloc[0])
            phi, acc = walk(top, domain, parts, t[["tx", "ty", "tz"]].to_numpy(), theta, t["pid"].to_numpy() if own else None, t["th"].to_numpy(), *give.what, above, whole, pull := np.zeros(len(t)))
            return give(t["pid"], phi, acc, pull)

        out = placed.repartition(tasks, *at).groupBy(*at).cogroup(exchanged.repartition(tasks, *at).groupBy(*at)).applyInPandas(act, give.schema)
        return out if len(at) == 1 else _added(out)

    def _exchange(self, points: DataFrame | None) -> tuple[DataFrame, DataFrame, Any]:
        placed, _, exchanged, shared, _ = self._asked(self._targets(points), points is None, self.theta)
        return placed, exchanged, shared

    def _asked(self, targets: DataFrame, own: bool, theta: float, again: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, Any, int]:
        """Targets with their ``block``; the pairs of ``block`` and ``domain, slice`` it looks into; ``block, slice, domain, whole, part``: of each domain what a block's box can reach of it, where it is ``whole`` as rows of particles; the tree above, broadcast; and the number of blocks.

        A block is some of a domain's targets, or those of several domains on end. ``again``: the targets are some of all.
        """
        spark, forest = self.snap.df.sparkSession, self.forest
        domains = forest.domains
        shared = spark.sparkContext.broadcast((forest.top, forest.domain))  # MOST_DOMAINS rows
        bundles, slice_of = forest.bundles, forest.slice_of

        def locate(batches):
            for t in batches:
                yield t.assign(block=domains.of_points(t[["tx", "ty", "tz"]].to_numpy()))

        located = targets.mapInPandas(locate, "pid long, tx double, ty double, tz double, th double, block long")
        held = forest.held if own and not again else {r["block"]: r["count"] for r in located.groupBy("block").count().collect()}  # MOST_DOMAINS rows
        n = sum(held.values())
        # A block holds as many targets as a domain has particles; under small angles it looks into most domains anyway, and takes the targets of several. Few targets are shared by all cores.
        wide = BLOCK if theta <= 0 else min(BLOCK, max(FEWEST, self.cell * (WIDE / theta) ** 3))
        most = max(1, min(max(self.cell, int(wide), -(-n // MOST_DOMAINS)), -(-n // ((1 if again else 4) * spark.sparkContext.defaultParallelism))))
        lead, chunks = dealt(np.array([held.get(i, 0) for i in range(len(domains.start))], np.int64), most)

        def deal(batches):
            for t in batches:
                at = t["block"].to_numpy()
                hashed = (t["pid"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                yield t.assign(block=lead[at] * CHUNKS + (hashed.astype(np.int64) % chunks[at]))

        placed = located.mapInPandas(deal, "pid long, tx double, ty double, tz double, th double, block long")
        boxes = placed.groupBy("block").agg(*[f(f"t{c}").alias(f"{name}{c}") for f, name in ((F.min, "l"), (F.max, "h")) for c in "xyz"], F.max("th").alias("h"))
        low, high = ["lx", "ly", "lz"], ["hx", "hy", "hz"]

        def look(batches):
            for b in batches:
                for row, a, z, h in zip(b.itertuples(index=False), b[low].to_numpy(), b[high].to_numpy(), b["h"].to_numpy(), strict=True):
                    found = needed(*shared.value, a, z, h, theta, own)
                    found = found.astype(np.int64)
                    yield pd.DataFrame(np.repeat([row[1:]], len(found), 0), columns=b.columns[1:]).assign(block=row[0], domain=found, slice=slice_of[found], bundle=found * bundles // len(slice_of))

        pairs = boxes.mapInPandas(look, "block long, lx double, ly double, lz double, hx double, hy double, hz double, h double, domain long, slice long, bundle long")

        def send(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"block": [], "slice": [], "domain": [], "whole": [], "part": []})]
            tree_of = dict(zip(trees["domain"], trees["tree"], strict=True))
            for d, some in asked.groupby("domain"):
                tree = pickle.loads(tree_of[d])
                lows, highs = some[low].to_numpy(), some[high].to_numpy()
                whole = tree.all_near(lows, highs, theta)
                rows = tree.rows() if whole.any() else b""
                parts = [rows if w else pickle.dumps(tree.essential(a, z, h, theta, own), 5) for w, a, z, h in zip(whole, lows, highs, some["h"].to_numpy(), strict=True)]
                out.append(some[["block", "slice", "domain"]].assign(whole=whole, part=parts))
            return pd.concat(out[1:] or out)

        exchanged = forest.trees.select("bundle", "domain", "tree").groupBy("bundle").cogroup(pairs.repartition(bundles, "bundle").groupBy("bundle")).applyInPandas(send, "block long, slice long, domain long, whole boolean, part binary")
        return placed, pairs, exchanged, shared, int(chunks[np.unique(lead)].sum())


class _Given:
    """The sums asked for: whether potentials and accelerations are to be computed, and the rows that give them."""

    def __init__(self, g: float, sums: Sequence[str]) -> None:
        if not sums or set(sums) - {*SUMS, "pull"}:
            raise ValueError(f"sums are some of {SUMS}")
        self.g, self.sums = g, tuple(sums)
        self.what = "phi" in sums, bool(set(sums) & set(SUMS[1:]))
        self.schema = ", ".join(["pid long", *[f"{c} double" for c in sums]])

    def __call__(self, ids: Any, phi: np.ndarray, acc: np.ndarray, pull: np.ndarray | None = None) -> pd.DataFrame:
        of = {"phi": phi, **dict(zip(SUMS[1:], acc.T, strict=True)), "pull": pull}
        return pd.DataFrame({"pid": ids, **{c: self.g * of[c] for c in self.sums}})


def _paired(particles: DataFrame, n: int) -> DataFrame:
    """Each row once for each of ``n`` blocks: ``i, j``, the pair of its own block and that one, and whether its own is the ``second``."""
    dealt = particles.withColumn("own", F.pmod(F.xxhash64("sid"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.select("sid", "sx", "sy", "sz", "sm", "sh", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("pid").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "pid"])


class Forest(NamedTuple):
    """The domains, a row with each one's tree, the tree above with each node's domain, the particles of each domain and of all, the slice of each domain (some ``SLICE`` particles on end), and the number of bundles that domains are kept in."""

    domains: Domains
    trees: DataFrame
    top: Tree
    domain: np.ndarray
    held: dict[int, int]
    n: int
    slice_of: np.ndarray
    bundles: int

    @property
    def slices(self) -> int:
        return int(self.slice_of[-1]) + 1


def _of(snap: Snapshot, softening: Any, kernel: str | None, **options: Any) -> Gravity:
    u = [snap.units.get(k) for k in ("pos", "mass", "vel")]
    return Gravity(snap, softening, kernel, g=gravity_constant(*u) if all(u) else 1.0, **options)


def _points(snap: Snapshot, positions: DataFrame | Sequence[Sequence[float]] | None) -> DataFrame | None:
    if positions is None or isinstance(positions, DataFrame):
        return positions
    p = np.asarray(positions, float).reshape(-1, 3)
    return snap.df.sparkSession.createDataFrame(pd.DataFrame({"pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))


def calculate_potential(snap: Snapshot, positions: Any = None, softening: Any = None, method: str = "tree", *, kernel: str | None = None, theta: float = 0.7, leaf_capacity: int = 8, multipole_order: int = 3) -> DataFrame:
    """``pid, phi`` in velocity units squared (G is 1 without units)."""
    g = _of(snap, softening, kernel, theta=theta, leaf_capacity=leaf_capacity, multipole_order=multipole_order)
    return _by(g, method, _points(snap, positions), ("phi",))


def calculate_acceleration(snap: Snapshot, positions: Any = None, softening: Any = None, method: str = "tree", *, kernel: str | None = None, theta: float = 0.7, leaf_capacity: int = 8, multipole_order: int = 3) -> DataFrame:
    """``pid, ax, ay, az`` in velocity units squared over length units."""
    g = _of(snap, softening, kernel, theta=theta, leaf_capacity=leaf_capacity, multipole_order=multipole_order)
    return _by(g, method, _points(snap, positions), ("ax", "ay", "az"))


def _by(g: Gravity, method: str, points: DataFrame | None, sums: Sequence[str]) -> DataFrame:
    if method not in ("tree", "direct"):
        raise ValueError(f"method {method!r} is neither tree nor direct")
    return getattr(g, method)(points, sums)
