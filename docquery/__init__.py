"""Queries over collections of JSON-like documents, compiled to Spark DataFrames."""

from importlib import import_module

_HOME = {
    "Collection": "collection", "Database": "database", "DbConfig": "ids", "IdType": "ids", "FieldInfo": "types", "JsonPrimitive": "types", "ReferenceColumn": "types", "SchemaDict": "types", "SchemaWithRefs": "types",
}
__all__ = sorted(_HOME)


def __getattr__(name: str) -> object:
    """Loaded when used, so that Python workers that need one module do not load all."""
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"docquery.{_HOME[name]}"), name)
