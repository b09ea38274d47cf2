"""A database: named collections, queries over them, and the references between them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.collection import Collection
from docquery.errors import LoadError, ParseError, ReferenceError_, SchemaError, UnknownCollection
from docquery.functions.registry import FunctionRegistry
from docquery.ids import DbConfig
from docquery.operators.expand import chain_of, expand_df, expand_documents
from docquery.plans.compiler import MISSING, Compiler, bind
from docquery.plans.parser import parse
from docquery.sources.schema_files import CompactSchema, check_config, collection_name, parse_compact, read_json
from docquery.sources.tables import as_collection, read_json_lines, read_parquet
from docquery.types import ReferenceColumn, SchemaWithRefs, decode, kind_of
from docquery.workers import let_import


class Database:
    """Collection names are case-insensitive.  ``compat`` keeps the quirks that the README lists."""

    def __init__(self, spark: SparkSession, config: DbConfig | None = None, compat: bool = False) -> None:
        let_import(spark)
        self.spark, self.config, self.compat = spark, config or DbConfig(), compat
        self.collections: dict[str, Collection] = {}
        self.references: list[ReferenceColumn] = []
        self.functions = FunctionRegistry(compat)

    # collections

    def create(self, name: str) -> Collection:
        return self.create_with_config(name, self.config)

    def create_with_config(self, name: str, config: DbConfig) -> Collection:
        """A new, empty collection, in place of one that has the name."""
        c = self.collections[name.lower()] = Collection(self.spark, name, config)
        return c

    def get(self, name: str) -> Collection | None:
        return self.collections.get(name.lower())

    def _need(self, name: str) -> Collection:
        c = self.get(name)
        if c is None:
            raise UnknownCollection(name)
        return c

    def list_collections(self) -> list[str]:
        return sorted(self.collections)

    def drop_collection(self, name: str) -> bool:
        self.references = [r for r in self.references if name.lower() not in (r.collection, r.ref_collection)]
        return self.collections.pop(name.lower(), None) is not None

    def clear(self) -> None:
        self.collections.clear()
        self.references.clear()

    def get_config(self) -> DbConfig:
        return self.config

    def register_df(self, name: str, df: DataFrame, config: DbConfig | None = None) -> Collection:
        c = self.create_with_config(name, config or DbConfig.none(df.columns[0]))
        c.register(as_collection(df))
        return c

    def register_parquet(self, name: str, path: str, config: DbConfig | None = None) -> Collection:
        """A Parquet table as a collection; with a config, its files are not touched before a query needs them."""
        if config is not None:
            c = self.create_with_config(name, config)
            c.register_later(lambda: read_parquet(self.spark, path))
            return c
        df = read_parquet(self.spark, path)
        c = self.create_with_config(name, config or DbConfig.none(df.columns[0]))
        c.register(df)
        return c

    def register_json(self, name: str, path: str, multi_line: bool = False, config: DbConfig | None = None) -> Collection:
        df = read_json_lines(self.spark, path, multi_line)
        c = self.create_with_config(name, config or DbConfig.none(df.columns[0]))
        c.register(df)
        return c

    # files

    def load_from_json(self, value: object, keep: bool = False) -> int:
        """{collection: [documents]}; each collection is made anew with the database's config."""
        if not isinstance(value, dict):
            raise LoadError("the root must be an object of collections")
        for name, docs in value.items():
            self.create(name).load_from_json(docs, keep)
        return len(value)

    def load_from_file(self, path: str | Path) -> str:
        n = self.load_from_json(read_json(path))
        return f"loaded {n} collections from {path}"

    def write_to_json(self) -> dict[str, list[dict]]:
        return {name: c.get_all() for name, c in sorted(self.collections.items())}

    def write_to_file(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.write_to_json(), indent=2, ensure_ascii=False), encoding="utf-8")

    # schemas

    def _apply_schema(self, name: str, compact: CompactSchema) -> None:
        c = self.get(name)
        if c is None:
            config = compact.config or self.config
            check_config(compact.schema, config)
            c = self.create_with_config(name, config)
        c.apply_schema(compact)

    def load_collection_schema_from_json(self, name: str, value: object) -> None:
        self._apply_schema(name, parse_compact(value))
        self._infer_all()

    def load_collection_schema_from_file(self, path: str | Path) -> str:
        name = collection_name(path)
        self.load_collection_schema_from_json(name, read_json(path))
        return name.lower()

    def load_schemas_from_json(self, value: object) -> int:
        if not isinstance(value, dict):
            raise SchemaError("the root must be an object of schemas")
        for name, v in value.items():
            self._apply_schema(name, parse_compact(v))
        self._infer_all()
        return len(value)

    def load_schemas_from_file(self, path: str | Path) -> str:
        n = self.load_schemas_from_json(read_json(path))
        return f"loaded {n} schemas from {path}"

    # queries

    def query(self, sql: str, args: object = MISSING) -> DataFrame:
        """The result as a lazy DataFrame, with columns in the order of SELECT."""
        try:
            q = parse(sql, self.compat)
        except RecursionError as e:
            raise ParseError("too deeply nested") from e
        values = bind(q, args, self.compat)
        return Compiler(lambda name: c.df() if (c := self.get(name)) else None, self.functions, values).compile(q)

    def query_with_args(self, sql: str, args: object) -> DataFrame:
        return self.query(sql, args)

    def query_rows(self, sql: str, args: object = MISSING) -> list[dict]:
        """The result as documents, for small results."""
        df = self.query(sql, args)
        kinds = [(f.name, kind_of(f)) for f in df.schema.fields]
        return [{name: decode(v, kind) for (name, kind), v in zip(kinds, row, strict=True)} for row in df.collect()]

    def query_json(self, sql: str, args: object = MISSING) -> DataFrame:
        """The result as one column of JSON objects, their keys in alphabetical order; absent values are null."""
        df = self.query(sql, args)
        return df.select(F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("json"))

    # references

    def create_reference(self, collection: str, column: str, ref_collection: str, ref_column: str) -> ReferenceColumn:
        a, b = self._need(collection), self._need(ref_collection)
        for c, col in ((a, column), (b, ref_column)):
            if c.schema().get(col) is None:
                raise ReferenceError_(f"{c.name} has no column {col!r}")
        out = ReferenceColumn(a.name, column, b.name, ref_column)
        if out not in self.references:
            self.references.append(out)
        return out

    def infer_reference(self, collection: str, ref_collection: str) -> ReferenceColumn:
        """By the conventional name of the column."""
        b = self._need(ref_collection)
        return self.create_reference(collection, b.get_reference_column_name(), ref_collection, b.config.id_key)

    def _infer_all(self) -> None:
        for a in self.list_collections():
            for b in self.list_collections():
                if a != b:
                    try:
                        self.infer_reference(a, b)
                    except ReferenceError_:
                        continue

    def get_collection_refs(self, name: str) -> list[ReferenceColumn]:
        """References that the collection holds, and mirrored ones that point to it."""
        n = self._need(name).name
        return [r for r in self.references if r.collection == n] + [ReferenceColumn(n, r.ref_column, r.collection, r.column, True) for r in self.references if r.ref_collection == n]

    def get_collection_column_ref(self, name: str, column: str) -> ReferenceColumn | None:
        return next((r for r in self.get_collection_refs(name) if r.column == column), None)

    def schema_with_refs_of(self, name: str) -> SchemaWithRefs | None:
        c = self.get(name)
        return SchemaWithRefs.new(c.schema(), self.get_collection_refs(name)) if c else None

    def _link(self, collection: str, target: str) -> tuple[str, str]:
        for r in self.get_collection_refs(collection):
            if r.ref_collection == target.lower():
                return r.column, r.ref_column
        raise ReferenceError_(f"{collection} has no reference to or from {target}")

    def expand_row(self, collection: str, row: dict, chain: str) -> dict:
        return self.expand_list(collection, [row], chain)[0]

    def expand_list(self, collection: str, rows: list[dict], chain: str) -> list[dict]:
        return expand_documents(rows, collection.lower(), [x.lower() for x in chain_of(chain)], lambda n, column, values: self._need(n).find(column, values), self._link)

    def expand_df(self, collection: str, chain: str, df: DataFrame | None = None) -> DataFrame:
        """All rows of a collection (or of df) with arrays of the documents that the chain leads to."""
        c = self._need(collection)
        return expand_df(c.df() if df is None else df, c.name, [x.lower() for x in chain_of(chain)], lambda n: self._need(n).df(), self._link)
