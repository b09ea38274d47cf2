"""Streams as collections.

The dialect has no streaming constructs.  A stream of Parquet or JSON files
becomes a collection like any other, and a query over it is a streaming query
within the limits of Structured Streaming: filters, projections and joins to
tables in append mode, aggregates in complete or update mode; sorting and
limits only in complete mode, no outer joins without watermarks.
"""

from __future__ import annotations

from pyspark.sql import types as T

from docquery.collection import Collection
from docquery.database import Database
from docquery.ids import DbConfig
from docquery.sources.tables import as_collection


def register_stream(db: Database, name: str, path: str, schema: T.StructType | str, kind: str = "parquet", config: DbConfig | None = None) -> Collection:
    """A folder that files are added to, as a collection; queries over it are started with ``writeStream``."""
    return db.register_df(name, as_collection(db.spark.readStream.format(kind).schema(schema).load(path)), config)
