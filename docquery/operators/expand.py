"""Expansion of references, one join a hop for all rows at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquery.types import ARRAY, FLOAT, INT, MIXED, NULL, OBJECT, canonical, kind_of


def chain_of(text: str) -> list[str]:
    """The names of a dotted chain, without empty ones."""
    return [x for x in (p.strip() for p in text.split(".")) if x]


def json_key(df: DataFrame, column: str) -> Column:
    """A value as JSON text, so that only equal values of one primitive match; null matches null."""
    kind = kind_of(df.schema[column])
    c = F.col(f"`{column}`")
    if kind is MIXED:
        return F.coalesce(F.concat(c["tag"].cast("string"), F.to_json(c)), F.lit("null"))
    if kind in (INT, FLOAT, NULL, OBJECT, ARRAY) and df.schema[column].dataType.simpleString() in ("string", "bigint", "double"):
        return F.coalesce(c.cast("string"), F.lit("null"))
    text = c.cast("string") if df.schema[column].dataType.simpleString() in ("string", "boolean") else F.to_json(c)
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')) if df.schema[column].dataType.simpleString() == "string" else text, F.lit("null"))


def _alike(a: DataFrame, x: str, b: DataFrame, y: str) -> bool:
    """Whether two columns are of one primitive and one plain type, so that equal JSON is equal values."""
    return kind_of(a.schema[x]) is kind_of(b.schema[y]) and a.schema[x].dataType == b.schema[y].dataType and a.schema[x].dataType.simpleString() in ("bigint", "string", "boolean")


def expand_df(df: DataFrame, collection: str, chain: list[str], lookup: Callable[[str], DataFrame], link: Callable[[str, str], tuple[str, str]]) -> DataFrame:
    """df with an array of matching documents for each hop, nested along the chain.

    link(collection, target) -> (column of the collection, column of the target).
    """
    if not chain:
        return df
    target = chain[0]
    own, other = link(collection, target)
    if own not in df.columns:
        return df
    inner = expand_df(lookup(target), target, chain[1:], lookup, link)
    mine, theirs, match = json_key(df, own), json_key(inner, other), F.col("_own") == F.col("_k")
    if _alike(df, own, inner, other):  # the values themselves: buckets and key types are of use
        mine, theirs, match = F.col(f"`{own}`"), F.col(f"`{other}`"), F.col("_own").eqNullSafe(F.col("_k"))
    groups = inner.groupBy(theirs.alias("_k")).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in inner.columns])).alias("_docs"))
    out = df.withColumn("_own", mine).join(groups, match, "left")
    empty = F.array().cast(groups.schema["_docs"].dataType)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != target], F.coalesce("_docs", empty).alias(target))


def expand_documents(docs: list[dict], collection: str, chain: list[str], lookup: Callable[[str, str, list], list[dict]], link: Callable[[str, str], tuple[str, str]]) -> list[dict]:
    """The same for documents that the driver holds; lookup(target, column, values) has the target's documents with one of the values."""
    if not chain:
        return [dict(d) for d in docs]
    target = chain[0]
    own, other = link(collection, target)
    index: dict[str, list[dict]] = {}
    found = lookup(target, other, [d[own] for d in docs if own in d])
    for raw, doc in zip(found, expand_documents(found, target, chain[1:], lookup, link), strict=True):
        index.setdefault(canonical(raw[other]), []).append(doc)
    return [{**d, target: index.get(canonical(d[own]), [])} if own in d else dict(d) for d in docs]
