"""Predicates and arithmetic with three-valued logic."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def holds(predicate: Column) -> Column:
    """True only where the predicate is; an unknown predicate changes no row."""
    return F.coalesce(predicate, F.lit(False))


def quotient(a: Column, b: Column) -> Column:
    """a / b as double; null for division by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def typed_compare(untyped: Column, other: Column, kind: str = "double") -> Column:
    """Equality of an untyped cell with a number; text that is no number compares as unknown."""
    return untyped.try_cast(kind) == other
