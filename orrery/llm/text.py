"""Column expressions that the operators on texts share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six white-space characters of the contracts.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words(c: Column) -> Column:
    """The words of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD_CLASS), F.lit(0))


def n_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD_CLASS)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: it becomes a lambda variable."""
    return F.transform(F.array(value), body)[0]


def put(df, **columns):
    """``df`` with the given columns, each in place of any column whose name differs only in case."""
    taken = {k.lower() for k in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])
