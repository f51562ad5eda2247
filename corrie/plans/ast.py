"""Syntax trees of statements. All nodes are frozen, so equal statements are equal keys."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: int | str | bool | None


@dataclass(frozen=True)
class Col:
    name: str
    table: str | None = None

    @property
    def label(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Op:
    op: str  # = <> < > <= >= AND OR + - *
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not:
    arg: Expr


@dataclass(frozen=True)
class IsNull:
    arg: Expr
    negated: bool = False


@dataclass(frozen=True)
class Agg:
    name: str  # COUNT SUM AVG MIN MAX
    arg: Expr | Star
    distinct: bool = False


Expr = Lit | Col | Op | Not | IsNull | Agg


@dataclass(frozen=True)
class Item:
    expr: Expr | Star
    alias: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None

    @property
    def scope(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    left: Source
    right: Table
    how: str  # inner left right full cross
    on: Expr | None = None
    using: tuple[str, ...] = ()


Source = Table | Join


@dataclass(frozen=True)
class Order:
    expr: Expr
    desc: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: Source
    where: Expr | None = None
    group_by: tuple[Col, ...] = ()
    having: Expr | None = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[tuple[str, str], ...]  # name, INTEGER VARCHAR BOOLEAN
    if_not_exists: bool = False
    unenforced: tuple[str, ...] = ()  # constraints and lengths, in words


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[int | str | bool | None, ...], ...] = field(repr=False)


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, Expr], ...]
    where: Expr | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class DropAll:
    pass


Statement = Select | CreateTable | Insert | Update | Delete | DropAll


def tables(source: Source) -> list[str]:
    return [source.name] if isinstance(source, Table) else [*tables(source.left), source.right.name]
