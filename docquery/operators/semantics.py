"""Three-valued predicates of the dialect as Columns, chosen by static types.

Comparisons never cast: unlike types, and order comparisons of strings and
booleans, are unknown.  A plain Spark predicate is emitted wherever it means
the same, so that it can be pushed to the scan.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquery.errors import InvalidLikePattern
from docquery.types import BOOL, MIXED, NULL, STRING, JsonPrimitive

OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
EPSILON = 1e-9


@dataclass
class Typed:
    """A scalar expression: its Column and primitive; ``const`` if it is a literal with ``value``."""

    col: Column
    kind: JsonPrimitive
    const: bool = False
    value: object = None


def literal(value: object) -> Typed:
    kind = JsonPrimitive.of_value(value)
    return Typed(F.lit(value) if kind is not NULL else F.lit(None).cast("string"), kind, True, value)


def truth(value: bool | None) -> Column:
    return F.lit(value).cast("boolean")


def _family(kind: JsonPrimitive) -> str | None:
    return "n" if kind.numeric else {BOOL: "b", STRING: "s"}.get(kind)


def part(x: Typed, family: str) -> Column:
    """The value of a mixed column where it is of the family, else null."""
    tag = {"b": 0, "n": 1, "s": 2}[family]
    return F.when(x.col["tag"] == tag, x.col[family])


def compare_values(op: str, a: object, b: object) -> bool | None:
    """Of two literals."""
    fa, fb = _family(JsonPrimitive.of_value(a)), _family(JsonPrimitive.of_value(b))
    if fa is None or fa != fb or (fa != "n" and op not in ("=", "<>")):
        return None
    if fa == "n" and (isinstance(a, float) or isinstance(b, float)):
        near = abs(a - b) < EPSILON
        return {"=": near, "<>": not near, "<": a < b and not near, "<=": a < b or near, ">": a > b and not near, ">=": a > b or near}[op]
    return OPS[op](a, b)


def compare(op: str, a: Typed, b: Typed) -> Column:
    if a.const and b.const:
        return truth(compare_values(op, a.value, b.value))
    if MIXED in (a.kind, b.kind):
        return _compare_mixed(op, a, b)
    fa, fb = _family(a.kind), _family(b.kind)
    if fa is None or fa != fb or (fa != "n" and op not in ("=", "<>")):
        return truth(None)
    return OPS[op](a.col, b.col)


def _compare_mixed(op: str, a: Typed, b: Typed) -> Column:
    if a.kind is MIXED and b.kind is MIXED:
        out = F.when((a.col["tag"] == 1) & (b.col["tag"] == 1), OPS[op](a.col["n"], b.col["n"]))
        if op in ("=", "<>"):
            for f, tag in (("b", 0), ("s", 2)):
                out = out.when((a.col["tag"] == tag) & (b.col["tag"] == tag), OPS[op](a.col[f], b.col[f]))
        return out
    mixed, other = (a, b) if a.kind is MIXED else (b, a)
    family = _family(other.kind)
    if family is None or (family != "n" and op not in ("=", "<>")):
        return truth(None)
    x = part(mixed, family)
    return OPS[op](x, other.col) if mixed is a else OPS[op](other.col, x)


def is_in(x: Typed, items: list[Typed], negated: bool, filtering: bool) -> Column:
    """Null is in no list and outside every list; a null in the list makes a miss unknown."""
    if x.const and all(i.const for i in items):
        hit = any(compare_values("=", x.value, i.value) for i in items)
        found = True if hit else None if any(i.kind is NULL for i in items) else False
        return truth(found if not negated or found is None else not found)
    nulls = any(i.kind is NULL for i in items)
    family = _family(x.kind)
    consts = [i.value for i in items if i.const and (x.kind is MIXED or family is not None and _family(i.kind) == family)]
    others = [i for i in items if not i.const]
    if filtering and not negated and not others and x.kind is not MIXED:
        return x.col.isin(consts) if consts else F.lit(False)
    hits = []
    if x.kind is MIXED:
        hits = [F.coalesce(compare("=", x, i), F.lit(False)) for i in items if i.kind is not NULL]
    else:
        if consts:
            hits.append(F.coalesce(x.col.isin(consts), F.lit(False)))
        hits += [F.coalesce(compare("=", x, i), F.lit(False)) for i in others]
    hit = F.lit(False)
    for h in hits:
        hit = hit | h
    null = F.lit(nulls)
    for i in others:
        null = null | i.col.isNull()
    out = F.when(hit, True).when(null, truth(None)).otherwise(False)
    return ~out if negated else out


def like_regex(pattern: str) -> str:
    """The regular expression of a LIKE pattern: % and _ do not match a line feed, a backslash takes the next character as it is."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(_quoted(pattern[at]))
        else:
            out.append(".*" if c == "%" else "." if c == "_" else _quoted(c))
        at += 1
    return "".join(out)


#: Characters that a regular expression reads as more than themselves.
SPECIAL = tuple("\\^$.|?*+()[]{}-&~#/")


def _quoted(c: str) -> str:
    return "\\" + c if c in SPECIAL else c


def like_regex_of(pattern: Column) -> Column:
    """The same for a column of patterns, a character at a time, inside the JVM."""
    done = lambda a, text, escaped: F.struct((F.concat(a["text"], text)).alias("text"), F.lit(escaped).alias("escaped"))

    def step(a: Column, c: Column) -> Column:
        literal_ = F.when(c.isin(*SPECIAL), F.concat(F.lit("\\"), c)).otherwise(c)
        special = F.when(c == "%", ".*").when(c == "_", ".").otherwise(literal_)
        return F.when(a["escaped"], done(a, literal_, False)).when(c == "\\", done(a, F.lit(""), True)).otherwise(done(a, special, False))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("escaped"))
    return F.aggregate(F.regexp_extract_all(pattern, F.lit("(?s)."), F.lit(0)), start, step, lambda a: F.concat(a["text"], F.when(a["escaped"], "\\\\").otherwise("")))


def like(x: Typed, pattern: Typed, negated: bool) -> Column:
    if pattern.const and pattern.value is not None and not isinstance(pattern.value, str):
        raise InvalidLikePattern(f"{pattern.value!r} is no LIKE pattern")
    text = part(x, "s") if x.kind is MIXED else x.col
    if x.kind not in (STRING, MIXED) or pattern.kind not in (STRING, MIXED):
        return truth(None)
    if pattern.const:
        if x.const:
            hit = re.match(like_regex(pattern.value) + r"\Z", x.value, re.IGNORECASE) is not None
            return truth(hit != negated)
        out = text.rlike(r"\A(?iud:" + like_regex(pattern.value) + r")\z")
    else:
        out = F.rlike(text, F.concat(F.lit(r"\A(?iud:"), like_regex_of(part(pattern, "s") if pattern.kind is MIXED else pattern.col), F.lit(r")\z")))
    return ~out if negated else out


def is_null(x: Typed, negated: bool) -> Column:
    return x.col.isNotNull() if negated else x.col.isNull()


def sort_key(x: Typed, descending: bool) -> Column:
    """Nulls come last either way; values of unlike types by rank."""
    return x.col.desc_nulls_last() if descending else x.col.asc_nulls_last()


