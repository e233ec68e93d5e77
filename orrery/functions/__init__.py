"""Column functions: guarded arithmetic, derived particle fields, softening kernels."""

from .arithmetic import clip, divide
from .derived import ALIASES, DERIVED, derived, resolve
from .kernels import force_factor, potential
from .quantities import UnitColumn, cross, dot

__all__ = ["ALIASES", "DERIVED", "UnitColumn", "clip", "cross", "derived", "divide", "dot", "force_factor", "potential", "resolve"]
