"""Particle-snapshot analytics on Spark DataFrames."""

from .functions import UnitColumn
from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .plans import Bound, Calculator, Combined, ErrorPolicy, Pipeline, Result, RunOptions, Scope
from .snapshot import Snapshot
from .sources import from_arrays, read_gadget, read_snapshot, write_gadget, write_snapshot
from .units import Unit

__all__ = [*_operators, "Bound", "Calculator", "Combined", "ErrorPolicy", "Pipeline", "Result", "RunOptions", "Scope", "Snapshot", "Unit", "UnitColumn", "from_arrays", "read_gadget", "read_snapshot", "write_gadget", "write_snapshot"]
