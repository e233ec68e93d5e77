"""Aggregates over particles that arrive as a stream. The batch calculators are used as they are: an aggregate's columns are valid in a streaming ``agg`` too."""

from .running import running

__all__ = ["running"]
