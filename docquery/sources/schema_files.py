"""Compact schemas: a JSON object of field -> type string.

``T`` is nullable, ``T!`` is not; ``Id`` (integers), ``Uuid`` and ``None:T``
(ids given by the caller) mark the one id field.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from docquery.errors import LoadError, SchemaError
from docquery.ids import DbConfig, IdType
from docquery.types import FLOAT, INT, NULL, STRING, FieldInfo, JsonPrimitive, SchemaDict

NAMES = {p.value: p for p in JsonPrimitive if p is not JsonPrimitive.MIXED}


@dataclass
class CompactSchema:
    schema: SchemaDict
    config: DbConfig | None


def parse_type(field: str, text: str) -> tuple[FieldInfo, IdType | None]:
    if text in ("Id", "Uuid"):
        return (FieldInfo(INT), IdType.INT) if text == "Id" else (FieldInfo(STRING), IdType.UUID)
    if text.startswith("None:"):
        kind = NAMES.get(text[5:])
        if kind not in (INT, FLOAT, STRING):
            raise SchemaError(f"{field}: {text!r}, an id given by the caller is Int, Float or String")
        return FieldInfo(kind), IdType.NONE
    name, bang = (text[:-1], True) if text.endswith("!") else (text, False)
    if name not in NAMES:
        raise SchemaError(f"{field}: unknown type {text!r}")
    if bang and NAMES[name] is NULL:
        raise SchemaError(f"{field}: Null is always nullable")
    return FieldInfo(NAMES[name], not bang), None


def parse_compact(value: object) -> CompactSchema:
    if not isinstance(value, dict):
        raise SchemaError("a compact schema is an object")
    schema, config = SchemaDict(), None
    for name, text in value.items():
        if not name.strip():
            raise SchemaError("empty field name")
        if not isinstance(text, str) or not text.strip():
            raise SchemaError(f"{name}: the type is a string")
        info, marker = parse_type(name, text.strip())
        if marker:
            if config:
                raise SchemaError(f"two id fields: {config.id_key} and {name}")
            config = DbConfig(marker, name)
        schema.fields[name] = info
    return CompactSchema(schema, config)


def check_config(schema: SchemaDict, config: DbConfig) -> None:
    """The id field exists, is not null and has a type that the strategy makes."""
    info = schema.get(config.id_key)
    if info is None:
        raise SchemaError(f"no id field {config.id_key!r}")
    if info.nullable:
        raise SchemaError(f"id field {config.id_key!r} is nullable")
    fits = {IdType.INT: (INT,), IdType.UUID: (STRING,), IdType.NONE: (INT, FLOAT, STRING)}[config.id_type]
    if info.ty not in fits:
        raise SchemaError(f"id field {config.id_key!r} is {info.ty.value}, not {' or '.join(k.value for k in fits)}")


def read_json(path: str | Path) -> object:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise LoadError(f"{path}: {e}") from e


def collection_name(path: str | Path) -> str:
    """The file's name without its suffix."""
    stem = Path(path).stem
    if not stem:
        raise LoadError(f"{path}: no file name")
    return stem
