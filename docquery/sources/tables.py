"""Tables as collections: columns of the seven primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_collection(df: DataFrame) -> DataFrame:
    """Integers widened, decimals and floats as doubles, dates and times as ISO text; nested columns stay as they are."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name.replace('`', '``')}`")
        t = f.dataType
        if isinstance(t, T.IntegralType):
            c = c if isinstance(t, T.LongType) else c.cast("long")
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            c = c.cast("string")
        elif isinstance(t, T.BinaryType):
            c = F.base64(c)
        elif isinstance(t, T.MapType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return as_collection(spark.read.parquet(path))


def read_json_lines(spark: SparkSession, path: str, multi_line: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """A distributed read, for files too large for the document API."""
    reader = spark.read.option("multiLine", multi_line)
    return as_collection((reader.schema(schema) if schema else reader).json(path))
