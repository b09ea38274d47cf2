"""Collections of documents.

Documents written through the API are held by the driver in a small delta; a
registered table is the base under it.  The DataFrame of a collection is the
delta and those base rows that the delta neither replaces nor removes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.errors import CollectionError, DuplicateId, InvalidDocument, LoadError, SchemaError
from docquery.ids import DbConfig, IdManager, IdType
from docquery.sources.schema_files import CompactSchema, check_config, parse_compact, read_json
from docquery.types import ARRAY, INT, NULL, OBJECT, STRING, FieldInfo, SchemaDict, canonical, decode, encode, kind_of, observed, struct_field

if TYPE_CHECKING:
    from docquery.database import Database

#: Values in one predicate over a registered table.
KEYS_AT_ONCE = 1000


def reference_column_name(name: str, id_key: str) -> str:
    """The column by which others refer to a collection, by convention."""
    base = name.lower().removesuffix("s")
    key = id_key.removeprefix("_")
    return key if key == f"{base}_id" or key.startswith(f"{base}_") else f"{base}_{key}"


class Collection:
    def __init__(self, spark: SparkSession, name: str, config: DbConfig | None = None) -> None:
        self.spark, self.name, self.config = spark, name.lower(), config or DbConfig()
        self.ids = IdManager(self.config.id_type)
        self.docs: dict[str, dict] = {}
        self._base: DataFrame | None = None
        self._load: Callable[[], DataFrame] | None = None
        self.gone: set[str] = set()
        self._schema = SchemaDict({self.config.id_key: FieldInfo(INT if self.config.id_type is IdType.INT else STRING)})
        self._frame: DataFrame | None = None

    @property
    def base(self) -> DataFrame | None:
        """The registered table; it is read when first asked for."""
        if self._load is not None:
            self._base, self._load = self._load(), None
        return self._base

    @base.setter
    def base(self, df: DataFrame | None) -> None:
        self._base, self._load = df, None

    # names and schema

    def get_name(self) -> str:
        return self.name

    def get_config(self) -> DbConfig:
        return self.config

    def schema(self) -> SchemaDict:
        if self.base is not None:
            return SchemaDict({f.name: FieldInfo(kind_of(f), f.nullable) for f in self.base.schema.fields} | {k: v for k, v in self._schema.fields.items() if k in {x for d in self.docs.values() for x in d}})
        return self._schema

    def get_reference_column_name(self) -> str:
        return reference_column_name(self.name, self.config.id_key)

    # reading

    def _with_keys(self, keys: Iterable[str]) -> Column:
        """The base's rows that have one of the ids, compared in the column's own type so that the scan is pruned."""
        name = self.config.id_key
        column, kind = F.col(f"`{name}`"), self.base.schema[name].dataType
        if isinstance(kind, T.LongType):
            return column.isin([int(k) for k in keys if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", k) and -(1 << 63) <= int(k) < 1 << 63])
        return (column if isinstance(kind, T.StringType) else column.cast("string")).isin(list(keys))

    def _base_row(self, key: str) -> dict | None:
        if self.base is None or key in self.gone:
            return None
        rows = self.base.where(self._with_keys([key])).limit(1).collect()
        return self._to_doc(rows[0], self.base.schema) if rows else None

    def _known(self, keys: list[str]) -> set[str]:
        """Those of the ids that exist, by one look at the base for each KEYS_AT_ONCE of them."""
        out = {k for k in keys if k in self.docs}
        rest = [k for k in dict.fromkeys(keys) if k not in out and k not in self.gone]
        if self.base is not None:
            for at in range(0, len(rest), KEYS_AT_ONCE):
                rows = self.base.where(self._with_keys(rest[at : at + KEYS_AT_ONCE])).select(F.col(f"`{self.config.id_key}`").cast("string")).collect()
                out |= {r[0] for r in rows}
        return out

    def find(self, column: str, values: Iterable[object]) -> list[dict]:
        """Documents whose column has one of the values: equal as JSON, so 1 is not 1.0; a document without the column never matches."""
        values = list(values)
        wanted = {canonical(v) for v in values}
        out = [dict(d) for d in self.docs.values() if column in d and canonical(d[column]) in wanted]
        base = self._kept_base() if wanted else None
        if base is not None and column in base.columns:
            kind, c = base.schema[column].dataType, F.col(f"`{column}`")
            own = {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BooleanType: bool}.get(type(kind))
            keys = [None] if own is None else [v for v in dict.fromkeys(values) if type(v) is own] if kind_of(base.schema[column]) not in (OBJECT, ARRAY) else [None]
            parts = [base.where(c.isin(keys[at : at + KEYS_AT_ONCE])) for at in range(0, len(keys), KEYS_AT_ONCE)] if keys != [None] else [base]
            if None in values and keys != [None]:
                parts.append(base.where(c.isNull()))
            found = [self._to_doc(r, base.schema) for p in parts for r in p.collect()]
            out += [d for d in found if canonical(d[column]) in wanted]
        return out

    def expand_row(self, row: dict, chain: str, db: Database) -> dict:
        return db.expand_row(self.name, row, chain)

    def expand_list(self, rows: list[dict], chain: str, db: Database) -> list[dict]:
        return db.expand_list(self.name, rows, chain)

    @staticmethod
    def _to_doc(row: T.Row, schema: T.StructType) -> dict:
        return {f.name: decode(row[f.name], kind_of(f)) for f in schema.fields}

    def get(self, key: object) -> dict | None:
        k = str(key)
        doc = self.docs.get(k)
        return dict(doc) if doc is not None else self._base_row(k)

    def exists(self, key: object) -> bool:
        return self.get(key) is not None

    def _kept_base(self) -> DataFrame | None:
        if self.base is None:
            return None
        hidden = sorted(self.gone | set(self.docs))
        if not hidden:
            return self.base
        own = self.base[self.config.id_key]
        if isinstance(self.base.schema[self.config.id_key].dataType, T.LongType):
            keys = self.spark.createDataFrame([(int(k),) for k in hidden if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", k) and -(1 << 63) <= int(k) < 1 << 63], "hidden_key long")
        else:
            keys, own = self.spark.createDataFrame([(k,) for k in hidden], "hidden_key string"), own.cast("string")
        return self.base.join(keys, own == keys["hidden_key"], "left_anti")

    def count(self) -> int:
        base = self._kept_base()
        return len(self.docs) + (base.count() if base is not None else 0)

    def get_all(self) -> list[dict]:
        return self.get_paginated(0, None)

    def get_paginated(self, offset: int, limit: int | None) -> list[dict]:
        """Documents in the order of insertion, then those of the base."""
        end = None if limit is None else offset + limit
        out = [dict(d) for d in list(self.docs.values())[offset:end]]
        base = self._kept_base()
        if base is not None and (limit is None or len(out) < limit):
            rest = base.orderBy(self.config.id_key).offset(max(offset - len(self.docs), 0))
            out += [self._to_doc(r, base.schema) for r in (rest if limit is None else rest.limit(limit - len(out))).collect()]
        return out

    def df(self) -> DataFrame:
        """Every document as a row: the id first, then the fields of the schema, objects and arrays of documents as JSON text."""
        if self._frame is None:
            names = list(dict.fromkeys([*self.schema().fields, *(k for d in self.docs.values() for k in d)]))
            kinds = {n: observed(d.get(n) for d in self.docs.values()) for n in names}
            for n, kind in kinds.items():
                info = self._schema.get(n)
                if kind is NULL and info is not None:
                    kinds[n] = info.ty
            base = self._kept_base()
            if base is not None:
                kinds |= {f.name: kind_of(f) for f in base.schema.fields if f.name in kinds}
            rows = [tuple(encode(d.get(n), kinds[n]) for n in names) for d in self.docs.values()]
            frame = self.spark.createDataFrame(rows, T.StructType([struct_field(n, kinds[n]) for n in names])) if rows or base is None else None
            if base is not None:
                frame = base if frame is None else base.unionByName(frame, allowMissingColumns=True)
            self._frame = frame
        return self._frame

    # writing

    def _changed(self) -> None:
        self._frame = None

    def _merge(self, doc: dict) -> None:
        self._schema.merge_schema(SchemaDict.infer_schema_from_object(doc))

    def _check(self, doc: object) -> dict:
        if not isinstance(doc, dict):
            raise InvalidDocument(f"{self.name}: a document is an object, not {type(doc).__name__}")
        return json.loads(json.dumps(doc))

    def _given_id(self, doc: dict) -> object:
        key = doc.get(self.config.id_key)
        if isinstance(key, bool) or not isinstance(key, (str, int, float)):
            raise InvalidDocument(f"{self.name}: {self.config.id_key!r} must be a string or number")
        return key

    def add(self, doc: object) -> dict:
        """Integer and UUID ids are always made; a caller's id must be new."""
        doc = self._check(doc)
        if self.config.id_type is IdType.NONE:
            key = self._given_id(doc)
            if self.exists(key):
                raise DuplicateId(f"{self.name}: {key!r} exists")
        else:
            key = doc[self.config.id_key] = self.ids.next()
        self._merge(doc)
        self.docs[str(key)] = doc
        self._changed()
        return dict(doc)

    def add_batch(self, docs: object) -> list[dict]:
        """Ids in documents are kept; not atomic: what comes before the first error stays."""
        if not isinstance(docs, list):
            raise InvalidDocument(f"{self.name}: a batch is an array")
        out = []
        known = self._known([str(d.get(self.config.id_key)) for d in docs if isinstance(d, dict)]) if self.config.id_type is IdType.NONE else set()
        for d in docs:
            d = self._check(d)
            key = d.get(self.config.id_key)
            if self.config.id_type is IdType.NONE:
                key = self._given_id(d)
                if str(key) in known:
                    raise DuplicateId(f"{self.name}: {key!r} exists")
                known.add(str(key))
            elif key is None:
                key = d[self.config.id_key] = self.ids.next()
            else:
                key = self._given_id(d)
                self.ids.seen(key)
            self._merge(d)
            self.docs.pop(str(key), None)
            self.docs[str(key)] = d
            out.append(dict(d))
        self._changed()
        return out

    def update(self, key: object, doc: object) -> dict | None:
        """Replace a document; None if there is none."""
        doc = self._check(doc)
        old = self.get(key)
        if old is None:
            return None
        doc.setdefault(self.config.id_key, old.get(self.config.id_key))
        self._merge(doc)
        self.docs[str(key)] = doc
        self._changed()
        return dict(doc)

    def update_partial(self, key: object, patch: object) -> dict | None:
        """Merge a patch into a document, objects field by field."""
        patch = self._check(patch)
        old = self.get(key)

        def merged(a: object, b: object) -> object:
            return {**a, **{k: merged(a[k], v) if k in a else v for k, v in b.items()}} if isinstance(a, dict) and isinstance(b, dict) else b

        return None if old is None else self.update(key, merged(old, patch))

    def delete(self, key: object) -> dict | None:
        doc = self.get(key)
        if doc is None:
            return None
        self.docs.pop(str(key), None)
        if self.base is not None:
            self.gone.add(str(key))
        self._changed()
        return doc

    def clear(self) -> int:
        """Remove all documents; the schema and the id sequence stay."""
        n = self.count()
        self._schema = self.schema()
        self.docs, self.base, self.gone = {}, None, set()
        self._changed()
        return n

    # files

    def load_from_json(self, value: object, keep: bool = False) -> int:
        if not isinstance(value, list):
            raise LoadError(f"{self.name}: the root must be an array")
        if not keep:
            self.clear()
        return len(self.add_batch(value))

    def load_from_file(self, path: str | Path) -> int:
        return self.load_from_json(read_json(path))

    def write_to_json(self) -> list[dict]:
        return self.get_all()

    def write_to_file(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.get_all(), indent=2, ensure_ascii=False), encoding="utf-8")

    def write_json_lines(self, path: str) -> None:
        """A distributed write of all documents."""
        self.df().write.mode("overwrite").json(path)

    def apply_schema(self, compact: CompactSchema) -> None:
        """Replace the schema; documents and the id sequence stay."""
        if compact.config is not None and compact.config != self.config:
            raise SchemaError(f"{self.name}: the schema's id {compact.config} differs from the collection's {self.config}")
        check_config(compact.schema, self.config)
        self._schema = compact.schema
        self._changed()

    def load_schema_from_json(self, value: object) -> None:
        self.apply_schema(parse_compact(value))

    def load_schema_from_file(self, path: str | Path) -> None:
        self.load_schema_from_json(read_json(path))

    def register(self, df: DataFrame) -> None:
        """Make a table the collection's base."""
        if self.config.id_key not in df.columns and self.config.id_type is not IdType.NONE:
            raise CollectionError(f"{self.name}: no column {self.config.id_key!r}")
        self.base, self.docs, self.gone = df, {}, set()
        self._changed()

    def register_later(self, load: Callable[[], DataFrame]) -> None:
        """Make a table the collection's base that is read when first used."""
        self.docs, self.gone, self._load = {}, set(), load
        self._changed()


