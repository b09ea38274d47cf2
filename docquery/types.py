"""The seven JSON primitives, schemas of collections, and their Spark types."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class JsonPrimitive(Enum):
    NULL = "Null"
    BOOL = "Bool"
    INT = "Int"
    FLOAT = "Float"
    STRING = "String"
    OBJECT = "Object"
    ARRAY = "Array"
    #: A column that holds values of several primitives; only physical columns have it.
    MIXED = "Mixed"

    @classmethod
    def of_value(cls, value: object) -> JsonPrimitive:
        if value is None:
            return cls.NULL
        if isinstance(value, bool):
            return cls.BOOL
        if isinstance(value, int):
            return cls.INT
        if isinstance(value, float):
            return cls.FLOAT
        if isinstance(value, str):
            return cls.STRING
        return cls.OBJECT if isinstance(value, dict) else cls.ARRAY

    @classmethod
    def promote(cls, a: JsonPrimitive, b: JsonPrimitive) -> JsonPrimitive:
        """Declared type of a column that has seen both; of unlike types the first stays."""
        if a is b or b is cls.NULL:
            return a
        if a is cls.NULL:
            return b
        return cls.FLOAT if {a, b} == {cls.INT, cls.FLOAT} else a

    @property
    def numeric(self) -> bool:
        return self in (JsonPrimitive.INT, JsonPrimitive.FLOAT)


NULL, BOOL, INT, FLOAT, STRING, OBJECT, ARRAY, MIXED = JsonPrimitive

#: Rank of a value among unlike ones, when sorted.
RANK = {BOOL: 0, INT: 1, FLOAT: 1, STRING: 2, ARRAY: 3, OBJECT: 4}

MIXED_TYPE = T.StructType([T.StructField("tag", T.IntegerType()), T.StructField("b", T.BooleanType()), T.StructField("n", T.DoubleType()), T.StructField("s", T.StringType())])


@dataclass
class FieldInfo:
    ty: JsonPrimitive
    nullable: bool = False

    @classmethod
    def infer_field_info(cls, value: object) -> FieldInfo:
        return cls(JsonPrimitive.of_value(value), value is None)

    def merge_field_info(self, other: FieldInfo) -> FieldInfo:
        return FieldInfo(JsonPrimitive.promote(self.ty, other.ty), self.nullable or other.nullable)


@dataclass
class SchemaDict:
    """Fields in the order in which they were first seen."""

    fields: dict[str, FieldInfo] = field(default_factory=dict)

    def get(self, name: str) -> FieldInfo | None:
        return self.fields.get(name)

    @classmethod
    def infer_schema_from_object(cls, doc: dict) -> SchemaDict:
        return cls({k: FieldInfo.infer_field_info(doc[k]) for k in sorted(doc)})

    def merge_schema(self, other: SchemaDict) -> None:
        """Fields the other lacks become nullable; its new fields are appended as they are."""
        for name, info in self.fields.items():
            found = other.fields.get(name)
            self.fields[name] = info.merge_field_info(found) if found else FieldInfo(info.ty, True)
        for name, info in other.fields.items():
            if name not in self.fields:
                self.fields[name] = FieldInfo(info.ty, info.nullable)


@dataclass(frozen=True)
class ReferenceColumn:
    collection: str
    column: str
    ref_collection: str
    ref_column: str
    is_referrer: bool = False


@dataclass
class SchemaWithRefs:
    """A schema with the references that its collection holds (inbound) and those that point to it (outbound)."""

    schema: SchemaDict
    inbound: list[ReferenceColumn] = field(default_factory=list)
    outbound: list[ReferenceColumn] = field(default_factory=list)

    @classmethod
    def new(cls, schema: SchemaDict, refs: Iterable[ReferenceColumn]) -> SchemaWithRefs:
        refs = list(refs)
        return cls(schema, [r for r in refs if not r.is_referrer], [r for r in refs if r.is_referrer])


def canonical(value: object) -> str:
    """JSON text with sorted keys and no spaces; floats keep their point."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def observed(values: Iterable[object]) -> JsonPrimitive:
    """The physical type of a column from the values it holds."""
    found = {JsonPrimitive.of_value(v) for v in values} - {NULL}
    if not found:
        return NULL
    if len(found) == 1:
        return next(iter(found))
    return FLOAT if found == {INT, FLOAT} else MIXED


SPARK = {NULL: T.StringType(), BOOL: T.BooleanType(), INT: T.LongType(), FLOAT: T.DoubleType(), STRING: T.StringType(), OBJECT: T.StringType(), ARRAY: T.StringType(), MIXED: MIXED_TYPE}


def struct_field(name: str, kind: JsonPrimitive) -> T.StructField:
    return T.StructField(name, SPARK[kind], True, {"json_primitive": kind.value})


def encode(value: object, kind: JsonPrimitive) -> object:
    """A document's value as Spark stores it in a column of that kind."""
    if value is None or kind is NULL:
        return None
    if kind is MIXED:
        own = JsonPrimitive.of_value(value)
        return (RANK[own], value if own is BOOL else None, float(value) if own.numeric else None, value if own is STRING else None if RANK[own] < 3 else canonical(value))
    if kind in (OBJECT, ARRAY):
        return canonical(value)
    return float(value) if kind is FLOAT else value


def decode(value: object, kind: JsonPrimitive) -> object:
    """The reverse of ``encode``, for result rows; rows and arrays of Spark become objects and lists."""
    if value is None:
        return None
    if kind is MIXED:
        tag = value["tag"]
        if tag == 1:
            return int(value["n"]) if value["n"].is_integer() else value["n"]
        return value["b"] if tag == 0 else value["s"] if tag == 2 else json.loads(value["s"])
    if kind in (OBJECT, ARRAY) and isinstance(value, str):
        return json.loads(value)
    return plain(value)


def plain(value: object) -> object:
    if isinstance(value, T.Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value


def kind_of(f: T.StructField) -> JsonPrimitive:
    """The primitive of a physical column."""
    if "json_primitive" in (f.metadata or {}):
        return JsonPrimitive(f.metadata["json_primitive"])
    t = f.dataType
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.IntegralType):
        return INT
    if isinstance(t, T.FractionalType):
        return FLOAT
    if isinstance(t, T.ArrayType):
        return ARRAY
    if isinstance(t, (T.StructType, T.MapType)):
        return MIXED if t == MIXED_TYPE else OBJECT
    return NULL if isinstance(t, T.NullType) else STRING
