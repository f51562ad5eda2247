"""A SELECT's tree to a DataFrame. Everything stays declarative; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions.aggregates import aggregate
from ..functions.predicates import Typed, equal, ordered
from ..operators.joins import join
from ..operators.scope import Field, Relation, scan
from ..types import is_arithmetic, literal_type
from . import ast


@dataclass(frozen=True)
class Source:
    """What the catalog gives for a name."""

    df: DataFrame
    order: str | None = None


class Lowering:
    def __init__(self, table: Callable[[str], Source], null_safe: bool = True) -> None:
        self.table, self.null_safe, self.numbers = table, null_safe, 0

    def next(self) -> int:
        self.numbers += 1
        return self.numbers

    # -- expressions

    def value(self, e: ast.Expr, scope: Relation, known: Mapping[ast.Expr, Field] | None = None) -> Typed:
        """known: what aggregates and keys are after grouping."""
        if known and e in known:
            return F.col(known[e].inner), known[e].type
        if isinstance(e, ast.Lit):
            return F.lit(e.value), literal_type(e.value)
        if isinstance(e, ast.Col):
            f = scope.resolve(e)
            if known is not None:
                key = next((k for c, k in known.items() if isinstance(c, ast.Col) and scope.resolve(c) == f), None)
                if key is None:
                    raise PlanError(f"column {e.label} must be in GROUP BY or in an aggregate")
                return F.col(key.inner), key.type
            return F.col(f.inner), f.type
        if isinstance(e, ast.Agg):
            raise PlanError(f"{e.name} is not allowed here")
        if isinstance(e, ast.Not):
            return ~self.truth(e.arg, scope, known), T.BooleanType()
        if isinstance(e, ast.IsNull):
            c, _ = self.value(e.arg, scope, known)
            return c.isNotNull() if e.negated else c.isNull(), T.BooleanType()
        if e.op in ("AND", "OR"):
            a, b = self.truth(e.left, scope, known), self.truth(e.right, scope, known)
            return a & b if e.op == "AND" else a | b, T.BooleanType()
        left, right = self.value(e.left, scope, known), self.value(e.right, scope, known)
        if e.op in ("+", "-", "*"):
            if not (is_arithmetic(left[1]) and is_arithmetic(right[1])):
                raise PlanError(f"{e.op} takes numbers")
            whole = all(isinstance(t, T.IntegralType | T.NullType) for t in (left[1], right[1]))
            a, b = (c.cast("long") if whole else c for c in (left[0], right[0]))
            return {"+": a + b, "-": a - b, "*": a * b}[e.op], T.LongType() if whole else T.DoubleType()
        if e.op in ("=", "<>"):
            same = equal(left, right, self.null_safe)
            return same if e.op == "=" else ~same, T.BooleanType()
        return ordered(e.op, left, right), T.BooleanType()

    def truth(self, e: ast.Expr, scope: Relation, known: Mapping[ast.Expr, Field] | None = None) -> Column:
        c, t = self.value(e, scope, known)
        if not isinstance(t, T.BooleanType | T.NullType):
            raise PlanError("a condition must be boolean")
        return c.cast("boolean") if isinstance(t, T.NullType) else c

    # -- FROM

    def source(self, s: ast.Source) -> Relation:
        if isinstance(s, ast.Table):
            found = self.table(s.name)
            return scan(found.df, s.scope, self.next(), found.order)
        left, right = self.source(s.left), self.source(s.right)
        on = (lambda both: self.truth(s.on, both)) if s.on is not None else None
        return join(left, right, s.how, on, s.using, self.null_safe, self.next())

    # -- SELECT

    def select(self, q: ast.Select, keep_order: bool = False) -> DataFrame:
        """keep_order: rows of one table that nothing else orders get a last column ORDERED, by which a caller can put them as they were inserted."""
        scope = self.source(q.source)
        if q.where is not None:
            scope = replace(scope, df=scope.df.filter(self.truth(q.where, scope)))
        if any(_aggregates(i.expr) for i in q.items) or q.group_by or q.having is not None:
            df, out, names, sort = self.grouped(q, scope)
        else:
            df, out, names = scope.df, [], []
            for item in q.items:
                if isinstance(item.expr, ast.Star):
                    fields = scope.of(item.expr.table) if item.expr.table else scope.fields
                    out += [F.col(f.inner) for f in fields]
                    names += [f.name for f in fields]
                else:
                    out.append(self.value(item.expr, scope)[0])
                    names.append(_label(item))
            sort = [self.sort_key(o, q, out, names, lambda e: self.value(e, scope)[0]) for o in q.order_by]
        inner = [f"o{i}" for i in range(len(out))]
        if q.distinct:
            df = df.select(*(c.alias(n) for c, n in zip(out, inner, strict=True)))
            positions = [self.position(o, q, names) for o in q.order_by]
            sort = [F.col(inner[i]) for i in positions]
            df = df.distinct()
        elif not sort and scope.order and scope.order in df.columns:
            if q.limit is not None or q.offset:
                sort = [F.col(scope.order)]
            elif keep_order:
                out, inner, names = [*out, F.col(scope.order)], [*inner, "order"], [*names, ORDERED]
        if sort:
            df = df.orderBy(*(c.desc_nulls_last() if o and o.desc else c.asc_nulls_last() for c, o in zip(sort, q.order_by or [None] * len(sort), strict=False)))
        if not q.distinct:
            df = df.select(*(c.alias(n) for c, n in zip(out, inner, strict=True)))
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.toDF(*names)

    def position(self, o: ast.Order, q: ast.Select, names: list[str]) -> int:
        for i, item in enumerate(q.items):
            if item.expr == o.expr:
                return i
        if isinstance(o.expr, ast.Col) and not o.expr.table and names.count(o.expr.name) == 1:
            return names.index(o.expr.name)
        raise PlanError("ORDER BY of SELECT DISTINCT takes selected columns")

    def sort_key(self, o: ast.Order, q: ast.Select, out: list[Column], names: list[str], value: Callable[[ast.Expr], Column]) -> Column:
        if isinstance(o.expr, ast.Lit) and type(o.expr.value) is int:
            if not 1 <= o.expr.value <= len(out):
                raise PlanError(f"ORDER BY position {o.expr.value} is not in the select list")
            return out[o.expr.value - 1]
        if isinstance(o.expr, ast.Col) and not o.expr.table:
            for i, item in enumerate(q.items):
                if item.alias == o.expr.name:
                    return out[i]
        return value(o.expr)

    def grouped(self, q: ast.Select, scope: Relation) -> tuple[DataFrame, list[Column], list[str], list[Column]]:
        known: dict[ast.Expr, Field] = {c: scope.resolve(c) for c in q.group_by}
        calls: list[Column] = []
        wanted = [*(i.expr for i in q.items), *([q.having] if q.having is not None else []), *(o.expr for o in q.order_by)]
        for call in dict.fromkeys(a for e in wanted for a in _aggregates(e)):
            arg = None if isinstance(call.arg, ast.Star) else scope.resolve(call.arg)
            sql, t = aggregate(call.name, arg and arg.inner, arg and arg.type, call.distinct)
            known[call] = Field("", call.name, f"a{len(calls)}", t)
            calls.append(F.expr(sql).alias(known[call].inner))
        keys = list(dict.fromkeys(known[c].inner for c in q.group_by))
        if calls:
            df = scope.df.groupBy(*keys).agg(*calls)
        else:
            df = scope.df.select(*keys).distinct()
        if any(isinstance(i.expr, ast.Star) for i in q.items):
            raise PlanError("* can't be selected with GROUP BY or an aggregate")
        out = [self.value(i.expr, scope, known)[0] for i in q.items]
        names = [_label(i) for i in q.items]
        if q.having is not None:
            df = df.filter(self.truth(q.having, scope, known))
        return df, out, names, [self.sort_key(o, q, out, names, lambda e: self.value(e, scope, known)[0]) for o in q.order_by]


#: The name of the column that select() adds for keep_order.
ORDERED = "__insertion"


def _aggregates(e: ast.Expr | ast.Star) -> list[ast.Agg]:
    if isinstance(e, ast.Agg):
        return [e]
    if isinstance(e, ast.Op):
        return _aggregates(e.left) + _aggregates(e.right)
    return _aggregates(e.arg) if isinstance(e, ast.Not | ast.IsNull) else []


def _label(item: ast.Item) -> str:
    e = item.expr
    return item.alias or (e.label if isinstance(e, ast.Col) else e.name if isinstance(e, ast.Agg) else "EXPR")
