"""Scalar and aggregate functions: a type rule and a Column builder for each name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquery.errors import FunctionArgMismatch, FunctionNotFound
from docquery.operators.semantics import Typed, literal, part
from docquery.types import ARRAY, FLOAT, INT, MIXED, NULL, OBJECT, STRING, JsonPrimitive

WHITE = r"\p{IsWhite_Space}+"
#: The code points that have the Unicode property White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@dataclass
class Scalar:
    build: Callable[[list[Typed], bool], Typed]


@dataclass
class Aggregate:
    """infer: kind of the result from the kind of the argument; build: Column from (argument, distinct); argument: what is built from, given its kind."""

    infer: Callable[[JsonPrimitive], JsonPrimitive]
    build: Callable[[Column, bool], Column]
    argument: Callable[[Column, JsonPrimitive, bool], Column] = lambda x, kind, distinct: x


def _one_string(name: str, apply: Callable[[Column], Column], fold: Callable[[str], object], kind: JsonPrimitive) -> Scalar:
    def build(args: list[Typed], strict: bool) -> Typed:
        if len(args) != 1:
            raise FunctionArgMismatch(f"{name} takes one argument")
        x = args[0]
        if x.kind not in (STRING, NULL, MIXED):
            if strict:
                raise FunctionNotFound(f"{name}({x.kind.value})")
            return literal(None)
        if x.const:
            return literal(fold(x.value) if x.value is not None else None)
        return Typed(apply(part(x, "s") if x.kind is MIXED else x.col), kind)

    return Scalar(build)


def _coalesce(args: list[Typed], strict: bool) -> Typed:
    if not args:
        raise FunctionArgMismatch("coalesce takes one argument or more")
    kind = NULL
    for x in args:
        if x.kind is NULL:
            continue
        if kind is not NULL and kind is not x.kind and not (kind.numeric and x.kind.numeric):
            raise FunctionArgMismatch(f"coalesce of {kind.value} and {x.kind.value}")
        kind = JsonPrimitive.promote(kind, x.kind)
    some = [x for x in args if x.kind is not NULL]
    if all(x.const for x in args):
        return literal(next((x.value for x in args if x.value is not None), None))
    return Typed(F.coalesce(*[x.col.cast("double") if kind is FLOAT else x.col for x in some]), kind) if some else literal(None)


def _number(name: str, kind: JsonPrimitive) -> JsonPrimitive:
    if not kind.numeric and kind is not NULL:
        raise FunctionArgMismatch(f"{name} of {kind.value}")
    return kind


def _exact(x: Column, kind: JsonPrimitive, distinct: bool) -> Column:
    """Distinct integers as decimals: no sum of them overflows, and no two become one."""
    return x.cast("decimal(20,0)") if distinct and kind is INT else x


def _ordered(name: str) -> Callable[[JsonPrimitive], JsonPrimitive]:
    def infer(kind: JsonPrimitive) -> JsonPrimitive:
        if kind in (OBJECT, ARRAY):
            raise FunctionArgMismatch(f"{name} of {kind.value}")
        return kind

    return infer


class FunctionRegistry:
    """Names are case-insensitive; ``register_scalar`` and ``register_aggregate`` add own functions, pandas UDFs among them."""

    def __init__(self, compat: bool = False) -> None:
        self.scalars: dict[str, Scalar] = {
            "upper": _one_string("upper", F.upper, str.upper, STRING),
            "lower": _one_string("lower", F.lower, str.lower, STRING),
            "trim": _one_string("trim", lambda x: F.regexp_replace(x, rf"^{WHITE}|{WHITE}$", ""), lambda s: s.strip(SPACES), STRING),
            "length": _one_string("length", lambda x: F.char_length(x).cast("long"), len, INT),
            "coalesce": Scalar((lambda a, s: Typed(literal(None).col, _coalesce(a, s).kind)) if compat else _coalesce),
        }
        self.aggregates: dict[str, Aggregate] = {
            "count": Aggregate(lambda k: INT, lambda x, d: F.count_distinct(x) if d else F.count(x)),
            "sum": Aggregate(lambda k: _number("sum", k), lambda x, d: F.sum_distinct(x) if d else F.sum(x)),
            "avg": Aggregate(lambda k: _number("avg", k) and FLOAT, lambda x, d: F.call_function("avg", x) if not d else F.sum_distinct(x).cast("double") / F.count_distinct(x), _exact),
            "min": Aggregate(_ordered("min"), lambda x, d: F.min(x)),
            "max": Aggregate(_ordered("max"), lambda x, d: F.max(x)),
        }

    def register_scalar(self, name: str, build: Callable[[list[Typed], bool], Typed]) -> None:
        self.scalars[name.lower()] = Scalar(build)

    def register_aggregate(self, name: str, infer: Callable[[JsonPrimitive], JsonPrimitive], build: Callable[[Column, bool], Column]) -> None:
        self.aggregates[name.lower()] = Aggregate(infer, build)

    def is_aggregate(self, name: str) -> bool:
        return name.lower() in self.aggregates

    def scalar(self, name: str) -> Scalar:
        if name.lower() not in self.scalars:
            raise FunctionNotFound(name)
        return self.scalars[name.lower()]
