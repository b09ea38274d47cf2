"""Operators for large text corpora; nothing else in the package imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("decontam", "langid", "licenses", "mixing", "quality", "simhash", "sketch", "substring", "suffix", "tokens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query of the subpackage."""
    return {name: q for m in MODULES for name, q in import_module(f"docquery.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {name: q for m in MODULES for name, q in import_module(f"docquery.llm.{m}").SQL.items()}
