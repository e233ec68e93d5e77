"""How an octree that no one place can hold is cut: domains are its nodes of at most so many particles.

What is above the domains is a tree of its own, whose leaves are the domains' roots; its other
nodes come from theirs by moving moments upwards. It is small (a row a domain) and goes to
every task. A box of targets walks it to find the domains of which it needs more.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

from .tree import DEPTH, INNER, LEAF, Tree, codes, indices, pair_sums, pairs_of, parted

#: Counts begin at this depth and go on by so many levels where a cell holds too many.
FIRST, STEP = 5, 2


def settle(counts: dict[int, int], depth: int, top: int, limit: int) -> tuple[list[tuple[int, int]], list[int]]:
    """From counts of cells at ``depth``: the largest cells at ``top`` or below of at most ``limit`` points, as (depth, number), and the cells that are above it still."""
    held = {depth: Counter(counts)}
    for d in range(depth - 1, top - 1, -1):
        held[d] = Counter()
        for c, n in held[d + 1].items():
            held[d][c >> 3] += n
    found = [(top, c) for c, n in held[top].items() if n <= limit]
    for d in range(top + 1, depth + 1):
        found += [(d, c) for c, n in held[d].items() if n <= limit < held[d - 1][c >> 3]]
    return found, [c for c, n in held[depth].items() if n > limit]


def dealt(held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of some ``most`` targets: for each domain the first of those it shares a block with, and the number of blocks it is cut into."""
    lead, first, total = np.arange(len(held)), 0, 0
    for i, k in enumerate(held.tolist()):
        if total + k > most:
            first, total = i, 0
        lead[i], total = first, total + k
    return lead, np.maximum(-(-held // most), 1)


@dataclass
class Domains:
    """Domains in order of their codes. ``cube``: centre and half the side of the root."""

    cube: tuple[np.ndarray, float]
    start: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, cube: tuple[np.ndarray, float], found: list[tuple[int, int]]) -> Domains:
        rows = sorted((c << 3 * (DEPTH - d), d) for d, c in found)
        return cls(cube, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]))

    def of_points(self, x: np.ndarray) -> np.ndarray:
        """The domain of each point; of one where there are no particles, the domain before it."""
        return np.maximum(np.searchsorted(self.start, codes(x, *self.cube), "right") - 1, 0)

    def top(self, roots: list[dict], order: int, kernel: str, soft: bool) -> tuple[Tree, np.ndarray]:
        """The tree above the domains, and the domain of each of its nodes (-1: none). ``roots``: what ``summary`` says of each domain."""
        deepest = int(self.depth.max())
        level_nodes = {d: {} for d in range(deepest + 1)}  # prefix -> domain or -1
        for i, (c, d) in enumerate(zip(self.start.tolist(), self.depth.tolist(), strict=True)):
            level_nodes[d][c >> 3 * (DEPTH - d)] = i
        for d in range(deepest, 0, -1):
            for c in level_nodes[d]:
                level_nodes[d - 1].setdefault(c >> 3, -1)
        parent, domain, half, levels, above = [-1], [], [], [0], {}
        for d in range(deepest + 1):
            order_of = sorted(level_nodes[d], key=lambda c: (above.get(c >> 3, -1), c))
            parent += [above[c >> 3] for c in order_of] if d else []
            domain += [level_nodes[d][c] for c in order_of]
            half += [self.cube[1] * 0.5**d] * len(order_of)
            above = {c: levels[-1] + i for i, c in enumerate(order_of)}
            levels.append(levels[-1] + len(order_of))
        parent, domain = np.array(parent), np.array(domain)
        kids = np.bincount(parent[1:], minlength=len(parent))
        n, at, none = len(parent), np.flatnonzero(domain >= 0), np.zeros(len(parent), int)
        # A domain that has children of its own may act as a whole; one that is a leaf never does.
        inner = np.array([r["inner"] for r in roots])
        kind = np.where(domain < 0, INNER, np.where(inner[domain], INNER, LEAF)).astype(np.int8)
        tree = Tree(np.zeros((0, 3)), np.zeros(0), np.zeros(0) if soft else None, np.zeros(0, int), none, none, np.array(half), parent, np.where(kids > 0, np.searchsorted(parent, np.arange(n)), 0), kids, kind, np.array(levels), *[np.empty(0)] * 4, order, kernel)
        count, geometric, weighted = np.zeros(n), np.zeros((n, 3)), np.zeros((n, 3))
        tree.total, tree.hmax, moments = np.zeros(n), np.zeros(n), np.zeros((n, len(indices(order if order > 1 else 0))))
        for node in at:
            r = roots[domain[node]]
            count[node], tree.total[node], tree.hmax[node], moments[node] = r["n"], r["total"], r["hmax"], r["moments"]
            com = np.array(r["com"])
            geometric[node], weighted[node] = com * r["n"], com * r["total"]
        tree.roll_up(count, geometric, weighted, moments)
        for node in at:
            tree.com[node] = roots[domain[node]]["com"]  # to the last place, so that it is judged alike everywhere
        return tree, domain


def summary(tree: Tree) -> dict:
    """What the tree above has to know of a domain: its root."""
    return {"n": len(tree.pos), "inner": bool(tree.kids[0]), "total": float(tree.total[0]), "com": tree.com[0].tolist(), "hmax": float(tree.hmax[0]), "moments": tree.moments[0].tolist()}


def needed(top: Tree, domain: np.ndarray, low: np.ndarray, high: np.ndarray, h: float, theta: float, own: bool) -> np.ndarray:
    """The domains of which targets in a box may need more than the root."""
    out, node = [], np.array([0])
    while len(node):
        node = node[top.total[node] != 0]
        node = node[(top.kind[node] == LEAF) | ~top.far_from_box(node, low, high, h, theta, own)]
        out.append(domain[node][domain[node] >= 0])
        node = top.below(node[domain[node] < 0])
    return np.concatenate(out) if out else np.zeros(0, int)


def walk(top: Tree, domain: np.ndarray, parts: dict[int, Tree], targets: np.ndarray, theta: float, own: np.ndarray | None, h: np.ndarray, potential: bool = True, force: bool = True, above: bool = True, whole: dict[int, np.ndarray] | None = None, pull: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Potential and acceleration at the targets: the tree above (if ``above``), and below it the parts that were sent. Of parts that are sent ``whole`` (rows of x, y, z, mass, softening, id) each particle acts. ``pull``: see ``Tree.evaluate``."""
    whole = whole or {}
    phi, acc, met, t, d = _above(top, domain, targets, theta, own, h, potential, force, above, pull)
    raw = [whole[i] for i in met.tolist() if i in whole]
    if raw:
        _each(top, phi, acc, slice(None), targets, own, h, np.concatenate(raw), potential, force)
    for i in met.tolist():
        if i in parts:
            p, a = parts[i].evaluate(targets, theta, own, h, potential, force, pull)
            phi += p
            acc += a
    by = np.argsort(d, kind="stable")
    t, d = t[by], d[by]
    found, first = np.unique(d, return_index=True)
    for i, lo, hi in zip(found.tolist(), first.tolist(), np.append(first[1:], len(d)).tolist(), strict=False):
        some = t[lo:hi]
        if i in whole:
            _each(top, phi, acc, some, targets, own, h, whole[i], potential, force)
        elif i in parts:
            pulled = None if pull is None else np.zeros(len(some))
            p, a = parts[i].evaluate(targets[some], theta, None if own is None else own[some], h[some], potential, force, pulled)
            phi[some] += p
            acc[some] += a
            if pull is not None:
                pull[some] += pulled
    return phi, acc


def _each(top: Tree, phi, acc, some, targets, own, h, rows, potential, force) -> None:
    soft = top.soft is not None
    p, a = pair_sums(targets[some], h[some], np.ascontiguousarray(rows[:, :3]), rows[:, 3].copy(), rows[:, 4].copy(), top.kernel, soft, own is not None, None if own is None else own[some], rows[:, 5].copy().view(np.int64), potential, force)
    phi[some] += p
    acc[some] += a


def _above(top: Tree, domain: np.ndarray, targets: np.ndarray, theta: float, own: np.ndarray | None, h: np.ndarray, potential: bool, force: bool, sums: bool, pull: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The sums over nodes above that are far; the domains into which all targets look; target and domain where but some do."""
    n = len(targets)
    phi, acc = np.zeros(n), np.zeros((n, 3))
    if not n:
        return phi, acc, *[np.zeros(0, int)] * 3
    low, high, most, is_own = targets.min(0), targets.max(0), h.max(), own is not None
    met, mixed, node = [], [], np.array([0])
    while len(node):
        far, leaf, near, each = top.sort_out(node, low, high, most, theta, is_own)
        for t, some in pairs_of(n if sums else 0, far):
            top._far(phi, acc, t, some, top.com[some] - targets[t], potential, force, pull)
        # A domain's root on which each target decides: its part has it too.
        met += [domain[x[domain[x] >= 0]] for x in (leaf, near, each)]
        mixed.append(each[domain[each] < 0])
        node = top.below(near[domain[near] < 0])
    t_met, d_met = [], []
    todo = [pairs for each in mixed for pairs in pairs_of(n, each)]
    while todo:
        t, node = todo.pop()
        alive = top.total[node] != 0
        t, node = t[alive], node[alive]
        far, d = top.far(targets, t, node, theta, h, is_own)
        if sums:
            top._far(phi, acc, t[far], node[far], d[far], potential, force, pull)
        t, node = t[~far], node[~far]
        root = domain[node] >= 0
        t_met.append(t[root])
        d_met.append(domain[node[root]])
        todo += parted(np.repeat(t[~root], top.kids[node[~root]]), top.below(node[~root]))
    t, d = (np.concatenate(x) if x else np.zeros(0, int) for x in (t_met, d_met))
    return phi, acc, np.concatenate(met), t, d
