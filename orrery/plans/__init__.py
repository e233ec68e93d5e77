"""Plan nodes: calculators, scopes, pipelines and their results."""

from .core import Aggregate, Bound, Calculator, Combined, CycleError, Scope, value_of
from .pipeline import Pipeline
from .result import ErrorPolicy, Result, RunOptions

__all__ = ["Aggregate", "Bound", "Calculator", "Combined", "CycleError", "ErrorPolicy", "Pipeline", "Result", "RunOptions", "Scope", "value_of"]
