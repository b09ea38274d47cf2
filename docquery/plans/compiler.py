"""Analysis of a query and its compilation to a DataFrame.

Each column of each source gets an internal name of its own, so neither the
case rules nor the names of Spark ever meet those of the dialect.  All errors
are raised here, before any job runs; what is returned is a lazy DataFrame
that Catalyst optimises as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.errors import AmbiguousColumn, FunctionArgMismatch, InvalidParameterValue, NotACollection, Other, UnknownCollection, UnknownColumn
from docquery.functions.registry import FunctionRegistry
from docquery.operators import semantics as sem
from docquery.operators.semantics import Typed
from docquery.plans.ast import And, Cmp, Col, Func, In, IsNull, Item, Like, Lit, Or, Param, Query, Source, Star
from docquery.types import FLOAT, INT, JsonPrimitive, kind_of

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full"}
MISSING = object()


@dataclass
class Visible:
    """A source under its visible name: internal name and primitive of each column, in order."""

    name: str
    columns: dict[str, tuple[str, JsonPrimitive]]


@dataclass
class Scope:
    sources: list[Visible] = field(default_factory=list)
    #: After aggregation: canonical text of a group column or aggregate -> (column name, primitive).
    grouped: dict[str, tuple[str, JsonPrimitive]] | None = None


def bind(query: Query, args: object, compat: bool = False) -> list:
    """Number the parameters of a query and return the argument list."""
    values = [] if args is MISSING else list(args) if isinstance(args, (list, tuple)) else [args]
    count = _number(query, 0, compat)
    if len(values) > count and args is not MISSING:
        raise InvalidParameterValue(f"{len(values)} arguments for {count} parameters")
    return values


def _number(q: Query, n: int, compat: bool) -> int:
    """Textual order; with ``compat`` ON comes first and each sub-query begins anew."""

    def walk(node: object) -> None:
        nonlocal n
        if isinstance(node, Param):
            node.index, n = n, n + 1
        elif isinstance(node, Query):
            m = _number(node, 0 if compat else n, compat)
            n = n if compat else m
        elif isinstance(node, Source):
            if node.query is not None:
                walk(node.query)
        elif isinstance(node, list):
            for x in node:
                walk(x)
        elif hasattr(node, "__dataclass_fields__") and not isinstance(node, (Lit, Col, Star)):
            for f in node.__dataclass_fields__:
                walk(getattr(node, f))

    if compat:
        order = [q.sources, [j.source for j in q.joins], [j.on for j in q.joins], [i.expr for i in q.items], q.where, q.having, [k.expr for k in q.order_by]]
    else:
        order = [[i.expr for i in q.items], q.sources, [[j.source, j.on] for j in q.joins], q.where, q.having, [k.expr for k in q.order_by]]
    for part in order:
        walk(part)
    return n


class Compiler:
    """lookup: collection name -> DataFrame with ``json_primitive`` metadata, or None."""

    def __init__(self, lookup: Callable[[str], DataFrame | None], functions: FunctionRegistry, args: list) -> None:
        self.lookup, self.functions, self.args = lookup, functions, args
        self.counter = 0

    # sources

    def source(self, s: Source) -> tuple[DataFrame, Visible]:
        df = self.compile(s.query) if s.query is not None else self.lookup(s.name)
        if df is None:
            raise UnknownCollection(s.name)
        if not isinstance(df, DataFrame):
            raise NotACollection(s.name)
        k = self.counter
        self.counter += 1
        columns = {f.name: (f"c{k}_{i}", kind_of(f)) for i, f in enumerate(df.schema.fields)}
        quoted = [F.col(f"`{name.replace('`', '``')}`").alias(inner) for name, (inner, _) in columns.items()]
        return df.select(*quoted), Visible(s.alias, columns)

    def from_clause(self, q: Query) -> tuple[DataFrame, Scope]:
        scope, df = Scope(), None
        for s in q.sources:
            one, seen = self.source(s)
            self.show(scope, seen)
            df = one if df is None else df.crossJoin(one)
        for j in q.joins:
            one, seen = self.source(j.source)
            self.show(scope, seen)
            df = df.join(one, self.predicate(j.on, scope, filtering=True), JOINS[j.kind])
        return df, scope

    @staticmethod
    def show(scope: Scope, seen: Visible) -> None:
        if any(v.name == seen.name for v in scope.sources):
            raise Other(f"two sources are named {seen.name!r}")
        scope.sources.append(seen)

    def resolve(self, c: Col, scope: Scope) -> tuple[str, JsonPrimitive]:
        if c.table is not None:
            for v in scope.sources:
                if v.name == c.table:
                    if c.name not in v.columns:
                        raise UnknownColumn(str(c), sorted(v.columns))
                    return v.columns[c.name]
            raise UnknownCollection(c.table)
        found = [v for v in scope.sources if c.name in v.columns]
        if not found:
            raise UnknownColumn(c.name, sorted({x for v in scope.sources for x in v.columns}))
        if len(found) > 1:
            raise AmbiguousColumn(c.name, [f"{v.name}.{c.name}" for v in found])
        return found[0].columns[c.name]

    # parameters

    def argument(self, p: Param) -> object:
        if p.index >= len(self.args):
            raise InvalidParameterValue(f"no argument for parameter {p.index + 1}")
        v = self.args[p.index]
        if isinstance(v, dict):
            raise InvalidParameterValue("an object is no parameter value")
        for x in v if isinstance(v, (list, tuple)) else [v]:
            if isinstance(x, (dict, list, tuple)) or not isinstance(x, (bool, int, float, str, type(None))):
                raise InvalidParameterValue(f"{x!r} is no parameter value")
            if isinstance(x, int) and not -(1 << 63) <= x < 1 << 63:
                raise InvalidParameterValue(f"{x} is out of range")
        return v

    # expressions

    def has_aggregate(self, e: object) -> bool:
        if isinstance(e, Func):
            return self.functions.is_aggregate(e.name) or any(map(self.has_aggregate, e.args))
        if isinstance(e, list):
            return any(map(self.has_aggregate, e))
        return hasattr(e, "__dataclass_fields__") and not isinstance(e, Query) and any(self.has_aggregate(getattr(e, f)) for f in e.__dataclass_fields__)

    def key(self, e: object, scope: Scope) -> str:
        """Canonical text of an expression: equal texts are one aggregate or group column."""
        if isinstance(e, Col):
            return self.resolve(e, scope)[0]
        if isinstance(e, Func):
            return f"{e.name.lower()}({'distinct ' * e.distinct}{','.join(self.key(a, scope) for a in e.args)})"
        if isinstance(e, Param):
            return f"={self.argument(e)!r}"
        return f"={e.value!r}" if isinstance(e, Lit) else "*"

    def scalar(self, e: object, scope: Scope, strict: bool = False) -> Typed:
        """strict: in the SELECT list, where a string function of another type is an error."""
        if isinstance(e, Lit):
            return sem.literal(e.value)
        if isinstance(e, Param):
            v = self.argument(e)
            if isinstance(v, (list, tuple)):
                raise InvalidParameterValue("a list is a parameter value only in IN")
            return sem.literal(v)
        if isinstance(e, Star):
            raise Other("* is no value here")
        if scope.grouped is not None:
            known = scope.grouped.get(self.key(e, scope))
            if known:
                return Typed(F.col(known[0]), known[1])
        if isinstance(e, Col):
            if scope.grouped is not None:
                raise Other(f"{e} is neither grouped nor aggregated")
            name, kind = self.resolve(e, scope)
            return Typed(F.col(name), kind)
        if self.functions.is_aggregate(e.name):
            raise Other(f"aggregate {e.name} is not allowed here")
        if e.distinct:
            raise Other(f"DISTINCT is not allowed in {e.name}")
        args: list[Typed] = []
        for a in e.args:
            v = self.argument(a) if isinstance(a, Param) else None
            args += [sem.literal(x) for x in v] if isinstance(v, (list, tuple)) else [self.scalar(a, scope, strict)]
        return self.functions.scalar(e.name).build(args, strict)

    def predicate(self, p: object, scope: Scope, filtering: bool = False) -> Column:
        """filtering: false and unknown are alike to whoever uses it."""
        if isinstance(p, (And, Or)):
            terms = [self.predicate(t, scope, filtering) for t in p.terms]
            out = terms[0]
            for t in terms[1:]:
                out = out & t if isinstance(p, And) else out | t
            return out
        if isinstance(p, Cmp):
            return sem.compare(p.op, self.scalar(p.left, scope), self.scalar(p.right, scope))
        if isinstance(p, IsNull):
            return sem.is_null(self.scalar(p.expr, scope), p.negated)
        if isinstance(p, Like):
            return sem.like(self.scalar(p.expr, scope), self.scalar(p.pattern, scope), p.negated)
        if isinstance(p, In):
            items: list[Typed] = []
            for i in p.items:
                v = self.argument(i) if isinstance(i, Param) else None
                items += [sem.literal(x) for x in v] if isinstance(v, (list, tuple)) else [self.scalar(i, scope)]
            return sem.is_in(self.scalar(p.expr, scope), items, p.negated, filtering)
        raise Other(f"no predicate: {p!r}")

    # clauses

    def expand(self, items: list[Item], scope: Scope) -> list[tuple[object, str | None, str | None]]:
        """(expression, alias, source's name) with wildcards expanded; an alias stays if a wildcard is one column."""
        out = []
        for i in items:
            if not isinstance(i.expr, Star):
                table = i.expr.table if isinstance(i.expr, Col) else None
                if isinstance(i.expr, Col) and table is None:
                    inner = self.resolve(i.expr, scope)[0]
                    table = next(v.name for v in scope.sources if inner in (c for c, _ in v.columns.values()))
                out.append((i.expr, i.alias, table))
                continue
            found = [v for v in scope.sources if i.expr.table in (None, v.name)]
            if i.expr.table is not None and not found:
                raise UnknownCollection(i.expr.table)
            columns = [(Col(v.name, c), v.name) for v in found for c in v.columns]
            out += [(c, i.alias if len(columns) == 1 else None, t) for c, t in columns]
        return out

    @staticmethod
    def name_outputs(items: list[tuple[object, str | None, str | None]]) -> list[str]:
        used: set[str] = set()
        names = []
        for e, alias, table in items:
            if alias:
                name = alias
            elif isinstance(e, Col):
                name = e.name if e.name not in used else f"{table}.{e.name}"
            else:
                name = e.name.lower() if isinstance(e, Func) else "_lit"
            base, n = name, 0
            while name in used:
                n += 1
                name = f"{base}_{n}"
            used.add(name)
            names.append(name)
        return names

    def aggregates(self, e: object, scope: Scope, found: dict[str, Func]) -> None:
        """Collect the aggregate calls of an expression, each once."""
        if isinstance(e, Func) and self.functions.is_aggregate(e.name):
            if any(map(self.has_aggregate, e.args)):
                raise Other(f"aggregate in the argument of {e.name}")
            found.setdefault(self.key(e, scope), e)
        elif isinstance(e, list):
            for x in e:
                self.aggregates(x, scope, found)
        elif hasattr(e, "__dataclass_fields__") and not isinstance(e, Query):
            for f in e.__dataclass_fields__:
                self.aggregates(getattr(e, f), scope, found)

    def aggregate(self, df: DataFrame, scope: Scope, groups: list[Col], calls: dict[str, Func]) -> tuple[DataFrame, Scope]:
        grouped: dict[str, tuple[str, JsonPrimitive]] = {}
        keys = []
        for g in groups:
            name, kind = self.resolve(g, scope)
            if name not in grouped:
                grouped[name] = (f"g{len(keys)}", kind)
                keys.append(F.col(name).alias(f"g{len(keys)}"))
        columns = []
        for k, (text, call) in enumerate(calls.items()):
            if len(call.args) != 1:
                raise FunctionArgMismatch(f"{call.name} takes one argument")
            rule = self.functions.aggregates[call.name.lower()]
            if isinstance(call.args[0], Star):
                if call.name.lower() != "count" or call.distinct or call.args[0].table:
                    raise FunctionArgMismatch("* is an argument of COUNT(*) only")
                out, kind = F.count(F.lit(1)), INT
            else:
                arg = self.scalar(call.args[0], scope)
                kind = rule.infer(arg.kind)
                col = arg.col.cast("double") if arg.kind is JsonPrimitive.NULL and kind is not INT else arg.col
                out = rule.build(rule.argument(col, arg.kind, call.distinct), call.distinct)
                kind = FLOAT if kind is JsonPrimitive.NULL else kind
            columns.append(out.alias(f"a{k}"))
            grouped[text] = (f"a{k}", kind)
        if not columns:
            columns = [F.count(F.lit(1)).alias("unused")]
        return df.groupBy(*keys).agg(*columns), Scope(scope.sources, grouped)

    def sort_keys(self, q: Query, items: list[tuple[object, str | None, str | None]], names: list[str], scope: Scope, grouping: bool) -> list[Column]:
        out = []
        for k in q.order_by:
            e = k.expr
            if isinstance(e, Lit) and isinstance(e.value, int) and not isinstance(e.value, bool):
                if not 1 <= e.value <= len(items):
                    raise Other(f"ORDER BY position {e.value} is out of range")
                e = items[e.value - 1][0]
            elif isinstance(e, Col) and e.table is None:
                same = str.lower if grouping else str
                hit = [x for (x, alias, _), _n in zip(items, names, strict=True) if alias and same(alias) == same(e.name)]
                e = hit[0] if hit else e
            elif isinstance(e, Param) and not grouping:
                raise Other("ORDER BY takes no parameter")
            out.append(sem.sort_key(self.scalar(e, scope), k.descending))
        return out

    def compile(self, q: Query) -> DataFrame:
        df, scope = self.from_clause(q)
        items = self.expand(q.items, scope)
        names = self.name_outputs(items)
        exprs = [e for e, _, _ in items]
        if q.where is not None:
            if self.has_aggregate(q.where):
                raise Other("aggregate in WHERE")
            df = df.filter(self.predicate(q.where, scope, filtering=True))
        grouping = bool(q.group_by) or self.has_aggregate(exprs) or (q.having is not None and self.has_aggregate(q.having))
        if q.having is not None and not grouping:
            raise Other("HAVING needs GROUP BY or an aggregate")
        if grouping:
            calls: dict[str, Func] = {}
            self.aggregates([exprs, q.having, [k.expr for k in q.order_by]], scope, calls)
            df, scope = self.aggregate(df, scope, q.group_by, calls)
            if q.having is not None:
                df = df.filter(self.predicate(q.having, scope, filtering=True))
        columns = []
        for e, name in zip(exprs, names, strict=True):
            t = self.scalar(e, scope, strict=True)
            columns.append(t.col.alias(name, metadata={"json_primitive": t.kind.value}))
        if q.order_by:
            df = df.orderBy(*self.sort_keys(q, items, names, scope, grouping))
        df = df.select(*columns)
        if q.offset:
            df = df.offset(q.offset)
        return df.limit(q.limit) if q.limit is not None else df
