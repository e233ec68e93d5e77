"""Fields that are computed from others, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arithmetic import divide

#: Vectors and the columns they stand for.
ALIASES: dict[str, tuple[str, ...]] = {"pos": ("x", "y", "z"), "vel": ("vx", "vy", "vz"), "acc": ("ax", "ay", "az")}
DERIVED: dict[str, Callable[[Callable[[str], Column]], Column]] = {}


def derived(name: str):
    """Register ``fn(field) -> Column`` as the derived field ``name``."""

    def put(fn):
        DERIVED[name] = fn
        return fn

    return put


def resolve(name: str, columns) -> Column:
    """The column of that name: a stored one first, else a derived one."""
    if name in columns:
        return F.col(f"`{name}`")
    if name in DERIVED:
        return DERIVED[name](lambda n: resolve(n, columns))
    raise KeyError(f"no field {name!r}; stored: {sorted(columns)}, derived: {sorted(DERIVED)}")


derived("r2")(lambda f: f("x") * f("x") + f("y") * f("y") + f("z") * f("z"))
derived("rxy2")(lambda f: f("x") * f("x") + f("y") * f("y"))
derived("r")(lambda f: F.sqrt(f("r2")))
derived("rxy")(lambda f: F.sqrt(f("rxy2")))
derived("v2")(lambda f: f("vx") * f("vx") + f("vy") * f("vy") + f("vz") * f("vz"))
derived("v")(lambda f: F.sqrt(f("v2")))
derived("ke")(lambda f: 0.5 * f("v2"))
derived("vr")(lambda f: divide(f("x") * f("vx") + f("y") * f("vy") + f("z") * f("vz"), f("r")))
derived("vcxy")(lambda f: divide(f("x") * f("vy") - f("y") * f("vx"), f("rxy")))
derived("vphi")(lambda f: f("vcxy"))
derived("vrxy")(lambda f: divide(f("x") * f("vx") + f("y") * f("vy"), f("rxy")))
derived("vtheta")(lambda f: divide(f("z") * f("vrxy") - f("vz") * f("rxy"), f("r")))
derived("jz")(lambda f: f("x") * f("vy") - f("y") * f("vx"))
