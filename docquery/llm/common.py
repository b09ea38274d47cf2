"""Tables, cut lineage and small helpers shared by the operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.workers import let_import

#: With it, the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python hold about BATCH_BYTES, however long the texts are; workers find this package."""
    let_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a folder of our own on one machine (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docquery-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator run, written to the shared folder.

    A written table ends the lineage: losing an executor later costs a reread
    and not the work before it.  Once it is written, Spark deletes the shuffle
    files of the work before.  ``drop`` removes a table that nothing reads any
    more, ``prune`` all that an operator wrote but what its result reads; the
    rest goes when a ``with`` block ends, or the program.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docquery-{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._remove, self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._remove(self.root)

    def _remove(self, path: str) -> None:
        """Delete a path of the shared folder, if the session still runs."""
        if self.spark.sparkContext._jsc is None:
            return
        with contextlib.suppress(Exception):
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        had = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if had is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, had)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._docquery_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_docquery_path", None)
        if path:
            self._remove(path)

    def prune(self, since: int, *kept: DataFrame) -> None:
        """Remove the tables written after there were ``since``, but those given."""
        paths = {getattr(df, "_docquery_path", None) for df in kept}
        for k in range(since + 1, self.count + 1):
            if f"{self.root}/{k}" not in paths:
                self._remove(f"{self.root}/{k}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that no column of df has, whatever its case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: str | object):
    """A-Z to a-z, all other characters unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
