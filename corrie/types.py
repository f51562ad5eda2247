"""The dialect's types and their Spark types; classes of types that compare with each other."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import PlanError

SPARK = {"INTEGER": T.LongType(), "VARCHAR": T.StringType(), "BOOLEAN": T.BooleanType()}


def type_class(t: T.DataType) -> str:
    """Types of one class compare; others are never equal."""
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NullType):
        return "null"
    return "time" if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else t.simpleString()


def literal_type(value: int | str | bool | None) -> T.DataType:
    if value is None:
        return T.NullType()
    return T.BooleanType() if isinstance(value, bool) else T.LongType() if isinstance(value, int) else T.StringType()


def check_value(value: int | str | bool | None, column: str, t: T.DataType) -> int | str | bool | None:
    """A literal that fits a column, or an error."""
    if value is not None and type_class(literal_type(value)) != type_class(t):
        raise PlanError(f"column {column} is {t.simpleString()}, {value!r} is not")
    return value


def type_name(t: T.DataType) -> str:
    return next((name for name, s in SPARK.items() if s == t), t.simpleString().upper())


def is_arithmetic(t: T.DataType) -> bool:
    return type_class(t) in ("int", "number", "null")


__all__ = ["SPARK", "check_value", "is_arithmetic", "literal_type", "type_class", "type_name"]
