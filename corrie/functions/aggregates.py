"""The five aggregates. Sums and averages of integers are 64-bit integers; averages are cut towards zero."""

from __future__ import annotations

from pyspark.sql import types as T

from ..errors import PlanError
from ..types import type_class


def aggregate(name: str, arg: str | None, t: T.DataType | None, distinct: bool) -> tuple[str, T.DataType]:
    """A Spark SQL expression over the column named arg (None: COUNT(*)), and its type."""
    each = "DISTINCT " if distinct else ""
    if name == "COUNT":
        return ("count(1)" if arg is None else f"count({each}`{arg}`)"), T.LongType()
    if name in ("MIN", "MAX"):
        return f"{name.lower()}(`{arg}`)", t
    kind = type_class(t)
    if kind not in ("int", "number"):
        raise PlanError(f"{name} takes numbers, not {t.simpleString()}")
    value = f"CAST(`{arg}` AS BIGINT)" if kind == "int" else f"`{arg}`"
    out = T.LongType() if kind == "int" else T.DoubleType()
    if name == "SUM":
        return f"sum({each}{value})", out
    if kind == "int":
        return f"sum({each}{value}) div count({each}{value})", out
    return f"avg({each}{value})", out
