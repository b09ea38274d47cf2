"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass
class Param:
    index: int = -1


@dataclass(frozen=True)
class Col:
    table: str | None
    name: str

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass
class Func:
    name: str
    args: list
    distinct: bool = False


@dataclass
class Cmp:
    op: str
    left: object
    right: object


@dataclass
class IsNull:
    expr: object
    negated: bool


@dataclass
class In:
    expr: object
    items: list
    negated: bool


@dataclass
class Like:
    expr: object
    pattern: object
    negated: bool


@dataclass
class And:
    terms: list


@dataclass
class Or:
    terms: list


@dataclass
class Source:
    name: str | None
    query: Query | None
    alias: str


@dataclass
class Join:
    kind: str
    source: Source
    on: object


@dataclass
class Item:
    expr: object
    alias: str | None


@dataclass
class Key:
    expr: object
    descending: bool


@dataclass
class Query:
    items: list[Item]
    sources: list[Source]
    joins: list[Join] = field(default_factory=list)
    where: object = None
    group_by: list[Col] = field(default_factory=list)
    having: object = None
    order_by: list[Key] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
