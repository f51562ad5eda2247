"""Comparisons: null-safe equality, and orderings that nothing of another type takes part in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import type_class

Typed = tuple[Column, T.DataType]


def _aligned(left: Typed, right: Typed) -> tuple[Column, Column] | None:
    """Both sides as they compare; None if their types never do."""
    a, b = type_class(left[1]), type_class(right[1])
    if a == b or {a, b} == {"int", "number"}:
        return left[0], right[0]
    if "null" in (a, b):
        return (left[0].cast(right[1]), right[0]) if a == "null" else (left[0], right[0].cast(left[1]))
    if {a, b} == {"time", "string"}:  # instants are written as strings
        return (left[0], F.try_to_timestamp(right[0]).cast(left[1])) if a == "time" else (F.try_to_timestamp(left[0]).cast(right[1]), right[0])
    return None


def equal(left: Typed, right: Typed, null_safe: bool = True) -> Column:
    """NULL equals NULL and nothing else; values of different types aren't equal."""
    pair = _aligned(left, right)
    if pair is None:
        return left[0].isNull() & right[0].isNull() if null_safe else F.lit(None).cast("boolean")
    return pair[0].eqNullSafe(pair[1]) if null_safe else pair[0] == pair[1]


def ordered(op: str, left: Typed, right: Typed) -> Column:
    """NULL (no match) with a NULL or a value of another type."""
    pair = _aligned(left, right)
    if pair is None:
        return F.lit(None).cast("boolean")
    a, b = pair
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
