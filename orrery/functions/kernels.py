"""Softening kernels: potential per unit mass and the factor of the separation in the acceleration, from r and h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("newton", "plummer", "spline")
#: What is put under the root so that no separation is 0.
TINY = 2.2250738585072014e-308
# The pieces of the cubic spline kernel as (power of u, coefficient), below 1/2 and from there to 1.
SPLINE_NEAR = ((2, 16 / 3), (4, -48 / 5), (5, 32 / 5), (0, -14 / 5))
SPLINE_FAR = ((-1, 1 / 15), (2, 32 / 3), (3, -16.0), (4, 48 / 5), (5, -32 / 15), (0, -16 / 5))


def polynomial(pieces, u, slope: bool = False):
    """The value, or the slope, at u; u may be a Column or an array."""
    out = None
    for n, c in pieces:
        if slope and n == 0:
            continue
        c, n = (c * n, n - 1) if slope else (c, n)
        p = 1.0
        for _ in range(abs(n)):
            p = p * u
        term = c * p if n >= 0 else c / p
        out = term if out is None else out + term
    return out


def potential(kind: str, r2: Column, h: Column | None) -> Column:
    r = F.sqrt(r2 + F.lit(TINY))
    if kind == "newton" or h is None:
        return -1 / r
    if kind == "plummer":
        return F.when(h > 0, -1 / F.sqrt(r2 + h * h)).otherwise(-1 / r)
    if kind == "spline":
        u = r / h
        inside = F.when(u < 0.5, polynomial(SPLINE_NEAR, u)).when(u < 1, polynomial(SPLINE_FAR, u)) / h
        return F.when((h > 0) & (u < 1), inside).otherwise(-1 / r)
    raise ValueError(f"kernel {kind!r} is none of {KINDS}")


def force_factor(kind: str, r2: Column, h: Column | None) -> Column:
    """g in a = m (source - target) g."""
    r = F.sqrt(r2 + F.lit(TINY))
    newton = F.when(r2 > 0, 1 / (r * r * r)).otherwise(0.0)
    if kind == "newton" or h is None:
        return newton
    if kind == "plummer":
        s = F.sqrt(r2 + h * h)
        return F.when(h > 0, 1 / (s * s * s)).otherwise(newton)
    if kind == "spline":
        u = r / h
        inside = F.when(u < 0.5, polynomial(SPLINE_NEAR, u, True)).when(u < 1, polynomial(SPLINE_FAR, u, True)) / (h * h * r)
        return F.when((h > 0) & (r2 == 0), 0.0).when((h > 0) & (u < 1), inside).otherwise(newton)
    raise ValueError(f"kernel {kind!r} is none of {KINDS}")
