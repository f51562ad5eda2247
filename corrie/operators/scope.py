"""Relations whose columns have unique internal names, and the rules that resolve names to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..plans import ast


@dataclass(frozen=True)
class Field:
    table: str
    name: str
    inner: str
    type: T.DataType


@dataclass(frozen=True)
class Relation:
    """A DataFrame, the fields it shows in order, and the hidden column that holds the insertion order, if any.

    hidden: key fields that USING has merged; only qualified names reach them.
    """

    df: DataFrame
    fields: tuple[Field, ...]
    order: str | None = None
    hidden: tuple[Field, ...] = ()

    def resolve(self, col: ast.Col) -> Field:
        found = [f for f in self.fields + (self.hidden if col.table else ()) if f.name == col.name and col.table in (None, f.table)]
        if len(found) != 1:
            if not found and col.table and col.table not in {f.table for f in self.fields}:
                raise PlanError(f"table {col.table} is not in FROM")
            raise PlanError(f"column {col.label} is {'ambiguous' if found else 'unknown'}")
        return found[0]

    def of(self, table: str) -> tuple[Field, ...]:
        found = tuple(f for f in self.fields if f.table == table)
        if not found:
            raise PlanError(f"table {table} is not in FROM")
        return found


def scan(df: DataFrame, alias: str, number: int, order: str | None = None) -> Relation:
    """A table under an alias; only renames, so column pruning and filters reach the files."""
    fields = tuple(Field(alias, f.name, f"c{number}_{i}", f.dataType) for i, f in enumerate(df.schema.fields) if f.name != order)
    cols = [F.col(f"`{f.name}`").alias(f.inner) for f in fields]
    inner = f"c{number}_order" if order else None
    return Relation(df.select(*cols, *([F.col(order).alias(inner)] if order else [])), fields, inner)
