"""Joins. Conditions are handed to Spark whole, so it finds the equi-keys, and picks and re-plans the algorithm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.predicates import equal
from ..plans import ast
from .scope import Field, Relation


def join(left: Relation, right: Relation, how: str, on: Callable[[Relation], Column] | None, using: tuple[str, ...], null_safe: bool, number: int) -> Relation:
    """`on` makes the condition over both sides. Without a condition every pair is joined."""
    both = {f.table for f in left.fields} & {f.table for f in right.fields}
    if both:
        raise PlanError(f"{both.pop()} is in FROM twice; give it an alias")
    fields = left.fields + right.fields
    if using:
        pairs = [(left.resolve(ast.Col(c)), right.resolve(ast.Col(c))) for c in using]
        cond = None
        for a, b in pairs:
            one = equal((F.col(a.inner), a.type), (F.col(b.inner), b.type), null_safe)
            cond = one if cond is None else cond & one
        df = left.df.join(right.df, cond, how)
        keys = []
        for i, (a, b) in enumerate(pairs):
            inner = f"u{number}_{i}"
            df = df.withColumn(inner, F.coalesce(F.col(a.inner), F.col(b.inner)) if how in ("full", "right") else F.col(a.inner))
            keys.append(Field("", a.name, inner, df.schema[inner].dataType))
        dropped = {f.inner for pair in pairs for f in pair}
        merged = tuple(f for pair in pairs for f in pair if f.table)
        return Relation(df, (*keys, *(f for f in fields if f.inner not in dropped)), hidden=left.hidden + merged)
    df = left.df.crossJoin(right.df) if on is None or how == "cross" else left.df.join(right.df, on(Relation(left.df, fields, hidden=left.hidden)), how)
    return Relation(df, fields, hidden=left.hidden)
