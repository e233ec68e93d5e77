"""Linear octrees with Cartesian moments, in numpy: what a task does with the particles it holds.

Particles in order of their Morton codes are a tree already: a node is a stretch of equal code
prefixes, and each level is cut from the one above by comparing neighbours. Moments are taken
about each leaf's centre of mass once and moved upwards, level by level. Targets walk a tree
together as a frontier of (target, node) pairs. ``essential`` keeps of a tree what a box of
targets can reach: nodes that all of them see under a small angle lose what is below.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

import numpy as np

from ..functions.kernels import SPLINE_NEAR, TINY

#: Nodes are not cut below this depth: coincident particles share a leaf. Three bits a level fill 63.
DEPTH = 21
#: Kinds of nodes: leaves are summed particle by particle; below closed ones nothing is known, and nothing is needed.
INNER, LEAF, CLOSED = 0, 1, 2
#: How much nearer a box counts than it is, so that what is closed for a box is closed for each place in it.
SLACK = 1e-9
#: Below this share of the softening length the spline's inner piece is taken as it is.
NEAR = 0.02
#: Pairs of target and node that a walk holds at once, for each level.
PAIRS = 250_000
#: A node is opened within so many softening lengths.
REACH = {"newton": 0.0, "plummer": 2.8, "spline": 1.0}


def indices(order: int) -> list[tuple[int, int, int]]:
    return [k for n in range(order + 1) for k in itertools.product(range(n + 1), repeat=3) if sum(k) == n]


def kernel_values(kind: str, r2: np.ndarray, h: np.ndarray | float, potential: bool = True, force: bool = True, p: np.ndarray | None = None, g: np.ndarray | None = None, least: float | None = None, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Potential per unit mass with its sign turned, and the factor of the separation in the acceleration; ``p`` and ``g`` are where to put them, ``least`` a lower bound of ``r2``, ``room`` five more arrays like it."""
    p = np.empty_like(r2) if p is None else p
    least = (r2.min() if r2.size else np.inf) if least is None else least
    if kind == "plummer" or not least > 0:
        np.add(r2, h * h + TINY if kind == "plummer" else TINY, out=p)
        np.sqrt(p, out=p)
    else:
        np.sqrt(r2, out=p)
    np.divide(1.0, p, out=p)
    if force:
        with np.errstate(over="ignore"):
            g = np.multiply(p, p, out=np.empty_like(r2) if g is None else g)
            g *= p
    if kind == "spline" and not least >= np.max(h, initial=0.0) ** 2:
        room = np.empty((5, *r2.shape)) if room is None else room
        within = np.flatnonzero(r2 < h * h)
        if 2 * len(within) > r2.size:
            soften(r2, h, potential, force, p, g, least, room)
        elif len(within):
            some = [x.reshape(-1)[within] if x is not None else None for x in (r2, p, g)]
            soften(some[0], np.broadcast_to(h, r2.shape).reshape(-1)[within] if np.ndim(h) else h, potential, force, *some[1:], least, [x.reshape(-1)[: len(within)] for x in room])
            for x, got in zip((p, g), some[1:], strict=True):
                if x is not None:
                    x.reshape(-1)[within] = got
    if force and not least > 0:
        g[r2 == 0] = 0.0
    return p, g


def soften(r2: np.ndarray, h: np.ndarray | float, potential: bool, force: bool, p: np.ndarray, g: np.ndarray | None, least: float, room: np.ndarray) -> None:
    """The spline kernel in place of 1/r and 1/r^3: with truncated powers of v = 1 - u and w = 1/2 - u, r times the potential is -1 + v^5 (16/5 - 32/15 v) - w^5 (32/5 - 128/15 w). At small u, where these cancel, its inner piece, and where all are below 1/2 that alone. ``least``: a lower bound of ``r2``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        if least > 0 and r2.max() < (0.5 * np.min(h)) ** 2:
            inner_piece(r2, h, potential, force, p, g, room)
            return
        by = 1.0 / h if np.ndim(h) else np.float64(np.inf if h == 0 else 1.0 / h)
        inner = not least >= (0.5 * np.max(h)) ** 2  # otherwise w is 0
        v, w, power, other, q = room
        np.multiply(r2, p, out=v)
        v *= by
        np.subtract(1.0, v, out=v)
        np.fmax(v, 0.0, out=v)
        np.multiply(v, v, out=power)
        power *= power
        np.multiply(v, -32 / 15, out=q)
        q += 16 / 5
        q *= v
        q *= power
        if force:
            np.multiply(v, 64 / 5, out=g)
            g -= 16.0
            g *= power
        if inner:
            np.subtract(v, 0.5, out=w)
            np.maximum(w, 0.0, out=w)
            np.multiply(w, w, out=other)
            other *= other
            part = np.multiply(w, -128 / 15, out=power)
            part += 32 / 5
            part *= w
            part *= other
            q -= part
            if force:
                w *= -256 / 5
                w += 32.0
                w *= other
                g += w
        if force:
            g *= np.minimum(by, 1e300)
            q -= 1.0
            g -= np.multiply(q, p, out=power)
            g *= np.multiply(p, p, out=power)
            q += 1.0
        np.subtract(1.0, q, out=q)
        p *= q
        near = h * NEAR
        inside = np.flatnonzero(r2 < near * near) if not least >= np.max(near) ** 2 else ()
        if len(inside):
            hh = np.broadcast_to(h, r2.shape).ravel()[inside]
            u = np.sqrt(r2.ravel()[inside] + TINY) / hh
            if potential:
                p.reshape(-1)[inside] = horner(SPLINE_NEAR, u) / -hh
            if force:
                g.reshape(-1)[inside] = horner(SPLINE_NEAR, u, True) / (u * hh**3)


def inner_piece(r2: np.ndarray, h: np.ndarray | float, potential: bool, force: bool, p: np.ndarray, g: np.ndarray | None, room: np.ndarray) -> None:
    """The spline kernel where all separations are above 0 and below half the softening length."""
    u, u2 = room[:2]
    np.multiply(r2, p, out=u)
    u *= 1.0 / h
    np.multiply(u, u, out=u2)
    if force:
        np.multiply(u, 32.0, out=g)
        g -= 192 / 5
        g *= u2
        g += 32 / 3
        g *= 1.0 / (h * h * h)
    if potential:
        np.multiply(u, 32 / 5, out=p)
        p -= 48 / 5
        p *= u2
        p += 16 / 3
        p *= u2
        p -= 14 / 5
        p *= -1.0 / h


def horner(pieces: tuple[tuple[int, float], ...], u: np.ndarray, slope: bool = False) -> np.ndarray:
    """The kernel's inner piece, or its slope, at u."""
    of = {n - slope: c * (n if slope else 1) for n, c in pieces if n or not slope}
    out = 0.0
    for n in range(max(of), -1, -1):
        out = out * u + of.get(n, 0.0)
    return out


class Meeting:
    """Two sets of particles, met tile by tile in room that is used again and fits a core's cache.

    Squares of separations are a matrix product, |x|^2 + |y|^2 - 2 xy about the middle of a tile's
    rows, and accelerations are products with the places of the sources. Pairs so close that
    these cancel are ``near`` and are taken from their separations one by one.
    """

    COLUMNS = 256
    #: Near pairs: those whose square is not above this share of the tile's largest |x|^2 + |y|^2.
    SHARE = 1e-3

    def __init__(self, kind: str, soft: bool, potential: bool, force: bool, pairs: int = 2**15) -> None:
        self.kind, self.soft, self.potential, self.force = kind, soft, potential, force
        self.columns = min(self.COLUMNS, pairs)
        self.rows = max(1, pairs // self.columns)
        self.room = np.empty((8 if kind == "spline" else 3, self.rows * self.columns))

    def tiles(self, a: np.ndarray, ha: np.ndarray | None, b: np.ndarray, hb: np.ndarray | None, ids: tuple[np.ndarray, np.ndarray] | None):
        """``rows, columns, p, g, x, y, near`` of each tile: ``x`` and ``y`` are the places about its middle, ``near`` the pairs whose ``g`` is left out: rows, columns, factors, separations. Without ``ha`` only ``hb`` softens; particles of one id do not act on each other."""
        for lo in range(0, len(a), self.rows):
            rows = slice(lo, lo + self.rows)
            middle = a[rows].mean(0)
            middle = np.where(np.isfinite(middle), middle, 0.0)
            x = a[rows] - middle
            xx = (x * x).sum(1)
            left = np.column_stack([-2.0 * x, xx, np.ones(len(x))])
            for at in range(0, len(b), self.columns):
                columns = slice(at, at + self.columns)
                y = b[columns] - middle
                yy = (y * y).sum(1)
                shape = len(x), len(y)
                r2, p, g, *more = (r[: shape[0] * shape[1]].reshape(shape) for r in self.room)
                np.dot(left, np.concatenate([y.T, np.ones((1, len(y))), yy[None]]), out=r2)
                h = self._lengths(None if ha is None else ha[rows], hb, columns)
                same = None if ids is None else ids[0][rows, None] == ids[1][None, columns]
                least, close = r2.min(), self.SHARE * (xx.max() + yy.max())
                near = None
                if not least > close:
                    i, j = np.nonzero(~(r2 > close))
                    d = b[columns][j] - a[rows][i]
                    near = i, j, *kernel_values(self.kind, (d * d).sum(1), np.broadcast_to(h, shape)[i, j], self.potential, self.force), d
                    r2[i, j] = max(close, 1.0) if close < np.inf else 1.0
                    least = close
                kernel_values(self.kind, r2, h, self.potential, self.force, p, g, least, more)
                if near is not None:
                    i, j, p_near, g_near, d = near
                    p[i, j] = p_near
                    near = None
                    if self.force:
                        g[i, j] = 0.0
                        near = i, j, g_near if same is None else np.where(same[i, j], 0.0, g_near), d
                if same is not None and same.any():
                    p[same] = 0.0
                    g[same] = 0.0
                yield rows, columns, p, g, x, y, near

    def _lengths(self, ha: np.ndarray | None, hb: np.ndarray | None, columns: slice) -> np.ndarray | float:
        """A tile's softening lengths: one number where all are equal."""
        if not self.soft:
            return 0.0
        hb = hb[columns]
        if (hb == hb[0]).all() and (ha is None or (ha == ha[0]).all()):
            return float(hb[0] if ha is None else max(ha[0], hb[0]))
        return hb[None] if ha is None else np.maximum(ha[:, None], hb[None])


def pulled(g: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The accelerations at ``x`` by masses at ``y``."""
    sums = g @ np.column_stack([m[:, None] * y, m])
    return sums[:, :3] - x * sums[:, 3:]


def by_place(x: np.ndarray, h: np.ndarray | None, many: int) -> np.ndarray | None:
    """An order in which particles on end are near each other and have one softening length, if there are few of these; None where there are too few pairs for it to be worth while."""
    if many < 1_000_000:
        return None
    with np.errstate(all="ignore"):
        code = codes(x, *cube_of(x))
    few = h is not None and len(np.unique(h[:1000])) <= 16
    return np.lexsort((code, h)) if few else np.argsort(code, kind="stable")


def _sorted(by: np.ndarray | None, *arrays: np.ndarray | None) -> list[np.ndarray | None]:
    return [x if by is None or x is None else x[by] for x in arrays]


def _back(by: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    if by is None:
        return x
    out = np.empty_like(x)
    out[by] = x
    return out


def pair_sums(t, th, s, m, sh, kind, soft, own, tid=None, sid=None, potential: bool = True, force: bool = True):
    phi, acc = np.zeros(len(t)), np.zeros((len(t), 3))
    if not len(t) or not len(s):
        return phi, acc
    one, other = by_place(t, th if soft and own else None, len(t) * len(s)), by_place(s, sh if soft else None, len(t) * len(s))
    t, th, tid = _sorted(one, t, th, tid)
    s, m, sh, sid = _sorted(other, s, m, sh, sid)
    for rows, columns, p, g, x, y, near in Meeting(kind, soft, potential, force).tiles(t, th if own else None, s, sh, (tid, sid) if own else None):
        if potential:
            phi[rows] -= p @ m[columns]
        if force:
            acc[rows] += pulled(g, x, y, m[columns])
            if near is not None:
                i, j, factor, d = near
                add_rows(acc[rows], i, (factor * m[columns][j])[:, None] * d)
    return _back(one, phi), _back(one, acc)


def mutual_sums(a, ha, ma, b, hb, mb, kind, soft, potential: bool = True, force: bool = True, pairs: int = 2**15):
    """The sums of two blocks of particles on each other: one kernel value a pair, accelerations equal and opposite."""
    phi, acc = (np.zeros(len(a)), np.zeros(len(b))), (np.zeros((len(a), 3)), np.zeros((len(b), 3)))
    if not len(a) or not len(b):
        return phi, acc
    one, other = (by_place(x, h if soft else None, len(a) * len(b)) for x, h in ((a, ha), (b, hb)))
    a, ha, ma = _sorted(one, a, ha, ma)
    b, hb, mb = _sorted(other, b, hb, mb)
    for rows, columns, p, g, x, y, near in Meeting(kind, soft, potential, force, pairs).tiles(a, ha, b, hb, None):
        if potential:
            phi[0][rows] -= p @ mb[columns]
            phi[1][columns] -= ma[rows] @ p
        if force:
            acc[0][rows] += pulled(g, x, y, mb[columns])
            acc[1][columns] += pulled(g.T, y, x, ma[rows])
            if near is not None:
                i, j, factor, d = near
                add_rows(acc[0][rows], i, (factor * mb[columns][j])[:, None] * d)
                add_rows(acc[1][columns], j, (-factor * ma[rows][i])[:, None] * d)
    return tuple(map(_back, (one, other), phi)), tuple(map(_back, (one, other), acc))


def add_rows(acc: np.ndarray, at: np.ndarray, f: np.ndarray) -> None:
    for k in range(3):
        acc[:, k] += np.bincount(at, f[:, k], len(acc))


def own_sums(a, h, m, ids, kind, soft, potential: bool = True, force: bool = True, block: int = 1000):
    """The sums of a block of particles on itself; each pair of its parts is met once."""
    by = by_place(a, h if soft else None, len(a) ** 2)
    a, h, m, ids = _sorted(by, a, h, m, ids)
    phi, acc = np.zeros(len(a)), np.zeros((len(a), 3))
    for lo in range(0, len(a), block):
        one, rest = slice(lo, lo + block), slice(lo + block, None)
        p, g = pair_sums(a[one], h[one], a[one], m[one], h[one], kind, soft, True, ids[one], ids[one], potential, force)
        (p1, p2), (g1, g2) = mutual_sums(a[one], h[one], m[one], a[rest], h[rest], m[rest], kind, soft, potential, force)
        phi[one] += p + p1
        acc[one] += g + g1
        phi[rest] += p2
        acc[rest] += g2
    return _back(by, phi), _back(by, acc)


def codes(x: np.ndarray, centre: np.ndarray, half: float) -> np.ndarray:
    """Morton codes in a cube, by the comparisons that lead down an octree."""
    out, c, h = np.zeros(len(x), np.int64), np.repeat(np.asarray(centre, float)[None], len(x), 0), half
    for _ in range(DEPTH):
        up = x >= c
        out = out << 3 | up @ np.array([1, 2, 4])
        h = 0.5 * h
        c += np.where(up, h, -h)
    return out


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as each size says."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def monomials(d: np.ndarray, order: int) -> np.ndarray:
    powers = [np.ones_like(d)]
    for _ in range(order):
        powers.append(powers[-1] * d)
    return np.stack([powers[i][:, 0] * powers[j][:, 1] * powers[k][:, 2] for i, j, k in indices(order)], 1)


def moved(moments: np.ndarray, shift: np.ndarray, order: int) -> np.ndarray:
    """Moments about a point that lies at ``-shift`` from their own: one axis after the other, a binomial sum each."""
    at = {k: i for i, k in enumerate(indices(order))}
    for axis in range(3):
        power = [np.ones(len(shift))]
        for _ in range(order):
            power.append(power[-1] * shift[:, axis])
        out = np.empty_like(moments)
        for k, i in at.items():
            n = k[axis]
            out[:, i] = sum(math.comb(n, j) * power[n - j] * moments[:, at[tuple(j if a == axis else v for a, v in enumerate(k))]] for j in range(n + 1))
        moments = out
    return moments


def safe_divide(a: np.ndarray, by: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.where(by[:, None] != 0, a / np.where(by != 0, by, 1)[:, None], other)


@dataclass
class Tree:
    """Nodes by level, children side by side; ``start`` to ``end`` are a leaf's particles."""

    pos: np.ndarray
    mass: np.ndarray
    soft: np.ndarray | None
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    half: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    kids: np.ndarray
    kind: np.ndarray
    levels: np.ndarray
    com: np.ndarray
    total: np.ndarray
    hmax: np.ndarray
    moments: np.ndarray
    order: int
    kernel: str

    @classmethod
    def build(cls, pos, mass, soft, ids, *, cube: tuple[np.ndarray, float] | None = None, depth: int = 0, leaf_capacity: int = 8, order: int = 3, kernel: str = "newton") -> Tree:
        """``cube``: centre and half the side of the whole tree's root, in which these particles share a node at ``depth``."""
        if leaf_capacity < 1:
            raise ValueError("a leaf holds a particle at least")
        pos, mass = np.asarray(pos, float).reshape(-1, 3), np.asarray(mass, float)
        centre, half0 = cube or cube_of(pos)
        code = codes(pos, centre, half0)
        by = np.argsort(code, kind="stable")
        pos, mass, ids, code = pos[by], mass[by], np.asarray(ids)[by], code[by]
        soft = None if soft is None else np.asarray(soft, float)[by]
        start, end, half, parent, levels = [np.array([0])], [np.array([len(pos)])], [np.array([half0 * 0.5**depth])], [np.array([-1])], [0, 1]
        for d in range(depth + 1, DEPTH + 1):
            a, b = start[-1], end[-1]
            cut = np.flatnonzero(b - a > leaf_capacity)
            if not len(cut):
                break
            size = b[cut] - a[cut]
            row, of = stretches(a[cut], size), np.repeat(cut, size)
            prefix = code[row] >> 3 * (DEPTH - d)
            at = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (of[1:] != of[:-1])]))
            start.append(row[at])
            end.append(row[at] + np.diff(np.append(at, len(row))))
            parent.append(of[at] + levels[-2])
            half.append(np.full(len(at), half0 * 0.5**d))
            levels.append(levels[-1] + len(at))
        start, end, half, parent = map(np.concatenate, (start, end, half, parent))
        kids = np.bincount(parent[1:], minlength=len(start))
        first = np.where(kids > 0, np.searchsorted(parent, np.arange(len(start))), 0)
        tree = cls(pos, mass, soft, ids, start, end, half, parent, first, kids, np.where(kids > 0, INNER, LEAF).astype(np.int8), np.array(levels), *[np.empty(0)] * 4, order, kernel)
        leaf = np.flatnonzero(kids == 0)
        leaf = leaf[np.argsort(start[leaf], kind="stable")]
        n = len(start)
        count, geometric, weighted = (end - start).astype(float), np.zeros((n, 3)), np.zeros((n, 3))
        tree.total, tree.hmax = np.zeros(n), np.zeros(n)
        moments = np.zeros((n, len(indices(order if order > 1 else 0))))
        if len(pos):
            add = lambda v: np.add.reduceat(v, start[leaf], axis=0)
            tree.total[leaf], geometric[leaf], weighted[leaf] = add(mass), add(pos), add(mass[:, None] * pos)
            if soft is not None:
                tree.hmax[leaf] = np.maximum.reduceat(soft, start[leaf])
            com = safe_divide(weighted[leaf], tree.total[leaf], geometric[leaf] / count[leaf][:, None])
            moments[leaf] = add(mass[:, None] * monomials(pos - np.repeat(com, (end - start)[leaf], 0), order if order > 1 else 0))
        tree.roll_up(count, geometric, weighted, moments)
        return tree

    def roll_up(self, count: np.ndarray, geometric: np.ndarray, weighted: np.ndarray, moments: np.ndarray) -> None:
        """From the sums and moments of nodes without children to those of all, a level at a time."""
        order = self.order if self.order > 1 else 0
        for lo, hi in reversed(list(zip(self.levels[1:-1], self.levels[2:], strict=True))):
            at = np.flatnonzero(np.diff(self.parent[lo:hi], prepend=-2))
            to = self.parent[lo:hi][at]
            for v in (self.total, count, geometric, weighted):
                v[to] = np.add.reduceat(v[lo:hi], at, axis=0)
            self.hmax[to] = np.maximum.reduceat(self.hmax[lo:hi], at)
        self.com = safe_divide(weighted, self.total, geometric / np.maximum(count, 1)[:, None])
        for lo, hi in reversed(list(zip(self.levels[1:-1], self.levels[2:], strict=True))):
            at = np.flatnonzero(np.diff(self.parent[lo:hi], prepend=-2))
            up = self.parent[lo:hi]
            moments[up[at]] = np.add.reduceat(moved(moments[lo:hi], self.com[lo:hi] - self.com[up], order), at, axis=0)
        self.moments = moments

    @property
    def reach(self) -> float:
        return REACH[self.kernel] if self.soft is not None else 0.0

    def below(self, node: np.ndarray) -> np.ndarray:
        return stretches(self.first[node], self.kids[node])

    def essential(self, low: np.ndarray, high: np.ndarray, h: float, theta: float, own: bool) -> Tree:
        """What targets in the box from ``low`` to ``high``, of softening up to ``h``, can reach of the tree. A node below which all of them come to every particle becomes a leaf."""
        keep, kind, near, levels, node = [], [], [], [0], np.array([0])
        while len(node):
            node = node[self.total[node] != 0] if levels != [0] else node
            closed = (self.kind[node] == CLOSED) | ((self.kind[node] == INNER) & self.far_from_box(node, low, high, h, theta, own))
            keep.append(node)
            kind.append(np.where(closed, CLOSED, self.kind[node]))
            near.append((kind[-1] == LEAF) | ((kind[-1] == INNER) & self.near_to_box(node, low, high, theta)))
            levels.append(levels[-1] + len(node))
            node = self.below(node[kind[-1] == INNER])
        # From below: a node is whole where it is near and all of its children are.
        place = np.full(len(self.start), -1)
        whole = near
        for d in range(len(keep) - 1, 0, -1):
            place[keep[d - 1]] = np.arange(len(keep[d - 1]))
            whole[d - 1][place[self.parent[keep[d][~whole[d]]]]] = False
        gone = np.zeros(len(self.start), bool)
        for d in range(len(keep)):
            if d:
                up = self.parent[keep[d]]
                place[keep[d - 1]] = np.arange(len(keep[d - 1]))
                gone[keep[d]] = gone[up] | whole[d - 1][place[up]]
            kind[d] = np.where(whole[d], LEAF, kind[d])
        stay = [~gone[k] for k in keep]
        levels = np.concatenate([[0], np.cumsum([x.sum() for x in stay])])
        keep, kind = (np.concatenate([v[x] for v, x in zip(of, stay, strict=True)]) for of in (keep, kind))
        kind = kind.astype(np.int8)
        place[keep] = np.arange(len(keep))
        parent = np.where(keep > 0, place[self.parent[keep]], -1)
        kids = np.bincount(parent[1:], minlength=len(keep))
        size = np.where(kind == LEAF, self.end[keep] - self.start[keep], 0)
        rows = stretches(np.where(kind == LEAF, self.start[keep], 0), size)
        end = np.cumsum(size)
        levels = np.array([x for i, x in enumerate(levels) if i == 0 or x != levels[i - 1]])
        return replace(
            self, pos=self.pos[rows], mass=self.mass[rows], soft=None if self.soft is None else self.soft[rows], ids=self.ids[rows], start=end - size, end=end, half=self.half[keep], parent=parent,
            first=np.where(kids > 0, np.searchsorted(parent, np.arange(len(keep))), 0), kids=kids, kind=kind, levels=levels, com=self.com[keep], total=self.total[keep], hmax=self.hmax[keep], moments=self.moments[keep],
        )

    def all_near(self, low: np.ndarray, high: np.ndarray, theta: float) -> np.ndarray:
        """For each box (a row of ``low`` and of ``high``) whether every place in it comes to every particle."""
        if theta <= 0:
            return np.ones(len(low), bool)
        node = np.flatnonzero((self.kind == INNER) & (self.total != 0))
        return np.array([bool(self.near_to_box(node, a, z, theta).all()) for a, z in zip(low, high, strict=True)], bool)

    def rows(self) -> bytes:
        """All particles, as rows of x, y, z, mass, softening and the bits of the id."""
        soft = np.zeros(len(self.pos)) if self.soft is None else self.soft
        return np.column_stack([self.pos, self.mass, soft, self.ids.astype(np.int64).view(float)]).tobytes()

    def far_from_box(self, node: np.ndarray, low: np.ndarray, high: np.ndarray, h: float, theta: float, own: bool) -> np.ndarray:
        com = self.com[node]
        away = np.maximum(np.maximum(low - com, com - high), 0.0)
        r2 = (away * away).sum(1) * (1 - SLACK)
        soft = (np.maximum(self.hmax[node], h) if own else self.hmax[node]) * self.reach
        return ((2 * self.half[node]) ** 2 < theta * theta * r2) & (r2 > soft * soft)

    def near_to_box(self, node: np.ndarray, low: np.ndarray, high: np.ndarray, theta: float) -> np.ndarray:
        """Whether each place in the box opens the node."""
        com = self.com[node]
        away = np.maximum(np.abs(com - low), np.abs(high - com))
        r2, soft = (away * away).sum(1) * (1 + SLACK), self.hmax[node] * self.reach
        return ((2 * self.half[node]) ** 2 >= theta * theta * r2) | (r2 <= soft * soft)

    def sort_out(self, node: np.ndarray, low: np.ndarray, high: np.ndarray, h: float, theta: float, own: bool) -> tuple[np.ndarray, ...]:
        """Nodes with mass by what a box of targets makes of them: far for all, leaves, opened by all, and those on which each target decides."""
        node = node[self.total[node] != 0]
        leaf = self.kind[node] == LEAF
        far = ~leaf & self.far_from_box(node, low, high, h, theta, own)
        near = ~leaf & ~far & self.near_to_box(node, low, high, theta)
        if (self.kind[node[near]] == CLOSED).any():
            raise AssertionError("a node is closed that a target opens")
        return node[far], node[leaf], node[near], node[~far & ~leaf & ~near]

    def far(self, targets: np.ndarray, t: np.ndarray, node: np.ndarray, theta: float, h: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are far, and their separations."""
        d = self.com[node] - targets[t]
        r2 = (d * d).sum(1)
        soft = (np.maximum(self.hmax[node], h[t]) if own else self.hmax[node]) * self.reach
        return (self.kind[node] != LEAF) & ((2 * self.half[node]) ** 2 < theta * theta * r2) & (r2 > soft * soft), d

    def evaluate(self, targets: np.ndarray, theta: float, own: np.ndarray | None = None, h: np.ndarray | None = None, potential: bool = True, force: bool = True, pull: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Potential and acceleration at the targets; ``own``: their ids, if they are the particles themselves. To ``pull`` is added how much far nodes pull in all, whatever their directions.

        The box of all targets walks first. Where it leaves a node open to decision each target walks on by itself; of such pairs no more than some ``PAIRS`` are held.
        """
        n = len(targets)
        phi, acc = np.zeros(n), np.zeros((n, 3))
        if not n or not len(self.start):
            return phi, acc
        h = np.zeros(n) if h is None or self.soft is None else h
        low, high, most = targets.min(0), targets.max(0), h.max()
        leaves, mixed, node = [], [], np.array([0])
        while len(node):
            far, leaf, near, each = self.sort_out(node, low, high, most, theta, own is not None)
            for t, some in pairs_of(n, far):
                self._far(phi, acc, t, some, self.com[some] - targets[t], potential, force, pull)
            leaves.append(leaf)
            mixed.append(each)
            node = self.below(near)
        leaf = np.concatenate(leaves)
        rows = stretches(self.start[leaf], self.end[leaf] - self.start[leaf])
        p, a = pair_sums(targets, h, self.pos[rows], self.mass[rows], None if self.soft is None else self.soft[rows], self.kernel, self.soft is not None, own is not None, own, self.ids[rows], potential, force)
        phi += p
        acc += a
        todo = [pairs for each in mixed for pairs in pairs_of(n, each)]
        while todo:
            t, node = todo.pop()
            alive = self.total[node] != 0
            t, node = t[alive], node[alive]
            leaf = self.kind[node] == LEAF
            far, d = self.far(targets, t, node, theta, h, own is not None)
            if (self.kind[node][~far] == CLOSED).any():
                raise AssertionError("a node is closed that a target opens")
            self._far(phi, acc, t[far], node[far], d[far], potential, force, pull)
            self._leaves(phi, acc, targets, t[leaf], node[leaf], own, h)
            rest = ~far & ~leaf
            todo += parted(np.repeat(t[rest], self.kids[node[rest]]), self.below(node[rest]))
        return phi, acc

    def _far(self, phi, acc, t, node, d, potential: bool = True, force: bool = True, pull: np.ndarray | None = None, block: int = 50_000) -> None:
        """Taylor series about the centre of mass: coefficients of 1/r by their three-term recurrence. From order 3 on the acceleration is the gradient of all that the potential has; below it is that of the mass alone."""
        full = self.order if self.order > 1 else 0
        forces = self.order if self.order > 2 else 0
        for lo in range(0, len(t), block):
            tt, nn, x = t[lo : lo + block], node[lo : lo + block], -d[lo : lo + block].T.copy()
            r2 = (x * x).sum(0)
            a = {(0, 0, 0): 1 / np.sqrt(r2)}
            for k in indices(max(full, forces + 1) if force else full)[1:]:
                size = sum(k)
                one, two = 0.0, 0.0
                for i in range(3):
                    if k[i]:
                        one = one + x[i] * a[tuple(v - (j == i) for j, v in enumerate(k))]
                    if k[i] > 1:
                        two = two + a[tuple(v - 2 * (j == i) for j, v in enumerate(k))]
                a[k] = ((2 * size - 1) * one - (size - 1) * two) / (size * r2)
            m = (self.moments[nn] if full else self.total[nn][:, None]).T.copy()
            p, f = np.zeros(len(tt)), np.zeros((3, len(tt)))
            for c, k in enumerate(indices(full)):
                if sum(k) == 1:
                    continue  # about the centre of mass there is no dipole
                if potential:
                    p -= m[c] * a[k]
                for i in range(3 if force and sum(k) <= forces else 0):
                    f[i] -= m[c] * (k[i] + 1) * a[tuple(v + (j == i) for j, v in enumerate(k))]
            add_up(phi, acc, tt, p, f.T)
            if pull is not None:
                pull += np.bincount(tt, np.abs(self.total[nn]) / r2, len(pull))

    def _leaves(self, phi, acc, targets, t, node, own, h, block: int = 200_000) -> None:
        k = self.end[node] - self.start[node]
        for lo in range(0, len(t), max(1, block // max(1, int(k.max()) if len(k) else 1))):
            hi = lo + max(1, block // max(1, int(k.max())))
            tt, kk = np.repeat(t[lo:hi], k[lo:hi]), k[lo:hi]
            j = stretches(self.start[node[lo:hi]], kk)
            d = self.pos[j] - targets[tt]
            soft = 0.0 if self.soft is None else (np.maximum(h[tt], self.soft[j]) if own is not None else self.soft[j])
            p, g = kernel_values(self.kernel, (d * d).sum(1), soft)
            if own is not None:
                keep = self.ids[j] != own[tt]
                p, g = p * keep, g * keep
            add_up(phi, acc, tt, -p * self.mass[j], (g * self.mass[j])[:, None] * d)


def pairs_of(n: int, node: np.ndarray):
    """Each of ``n`` targets with each node, some ``PAIRS`` at a time."""
    step = max(1, PAIRS // max(len(node), 1))
    for lo in range(0, n if len(node) else 0, step):
        t = np.arange(lo, min(lo + step, n))
        for left in range(0, len(node), PAIRS):
            some = node[left : left + PAIRS]
            yield np.repeat(t, len(some)), np.tile(some, len(t))


def parted(t: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(t[lo : lo + PAIRS], node[lo : lo + PAIRS]) for lo in range(0, len(t), PAIRS)]


def add_up(phi: np.ndarray, acc: np.ndarray, t: np.ndarray, p: np.ndarray, f: np.ndarray) -> None:
    if len(t):
        at, back = np.unique(t, return_inverse=True)
        phi[at] += np.bincount(back, p)
        for i in range(3):
            acc[at, i] += np.bincount(back, f[:, i])


def cube_of(pos: np.ndarray) -> tuple[np.ndarray, float]:
    low, high = (pos.min(0), pos.max(0)) if len(pos) else (np.zeros(3), np.zeros(3))
    return 0.5 * (low + high), max(0.5 * float((high - low).max()), 1e-6)
