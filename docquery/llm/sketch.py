"""Operator 8: threshold-scaled sketches of documents, DataFrame functions only.

A sketch keeps every distinct hash of a text's word shingles that is below a
fixed fraction of the hash range.  Sketches of parts merge by union, and the
share of one sketch found in another estimates containment however unequal the
two documents are.  So that no text with words has an empty sketch, its
smallest hash is kept even where it is above the threshold (the union of two
sketches still holds the smallest hash of both).

Nulls and empty texts have an empty sketch; two empty sketches are alike (1),
an empty and another are not (0).  Repeated rows each get their row.  The next
document of a row is the row that follows by ascending id, then text; null ids
come first, and the first row follows the last; rows of one id (ties) are
ordered by a digest of their texts.  An empty table gives an empty one.  The
whole of a long text is sketched, and its edited text in full.  Columns other
than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm.common import table

#: Hashes are kept if their top KEEP_BITS bits are zero: one in 2**KEEP_BITS.
KEEP_BITS = 2
SHINGLE = 5
#: Ranges of ids: one for so many rows, or as many as there are shuffle partitions; a row is compared with the square root of their number, twice.
RANGE_ROWS, MOST_RANGES = 20_000, 40_000


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Hashes, with the sign bit cleared, of the shingles of ``size`` words (all words, if fewer)."""
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")

    def at(ws: Column, i: Column) -> Column:
        return F.xxhash64(*(F.get(ws, i + k) for k in range(size)))

    def rolled(ws: Column) -> Column:
        last = F.greatest(F.size(ws) - size, F.lit(0))
        return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftrightunsigned(at(ws, i), 1)))

    # one-element transform: the words are split once and not for each use
    return F.get(F.transform(F.array(words), rolled), 0)


def sketch(text: Column, keep_bits: int = KEEP_BITS, size: int = SHINGLE) -> Column:
    """Sorted distinct kept hashes."""

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: F.shiftright(x, 63 - keep_bits) == 0)
        return F.when((F.size(low) > 0) | (F.size(h) == 0), F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(h)))

    return F.get(F.transform(F.array(shingle_hashes(F.coalesce(text, F.lit("")), size)), kept), 0)


def text_of(s: Column) -> Column:
    """A sketch as a string of 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merge(a: Column, b: Column, keep_bits: int = KEEP_BITS) -> Column:
    """Sketch of two texts together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: F.shiftright(x, 63 - keep_bits) == 0)
    return F.when((F.size(low) > 0) | (F.size(both) == 0), low).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    common = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - common
    return F.when(whole == 0, 1.0).otherwise(common / whole)


def range_of(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are x or less: first among every so manieth of them, then among those that follow it."""
    step = max(1, isqrt(len(cuts)))
    below = lambda some: F.size(F.filter(some, lambda c: c <= x))
    if len(cuts) <= 16:
        return below(F.array(*map(F.lit, cuts))) if cuts else F.lit(0)
    coarse = below(F.array(*map(F.lit, cuts[::step])))
    fine = F.array(*[F.array(*map(F.lit, cuts[i + 1 : i + step])) if cuts[i + 1 : i + step] else F.filter(F.array(F.lit(cuts[0])), lambda c: F.lit(False)) for i in range(0, len(cuts), step)])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + 1 + below(F.get(fine, coarse - 1)))


def with_next(docs: DataFrame, order: str, carried: dict[str, Column], parts: int) -> DataFrame:
    """Rows with ``next_<name>`` of the row that follows by ``order`` (nulls first, the first follows the last).

    The rows are dealt to ``parts`` ranges by approximate quantiles of
    ``order``, those without one to 256 ranges of the texts' digests, so no
    single task has all rows; each range also gets, as its
    end, a copy of the row that begins the next one that has rows.  What is
    broadcast is a table of at most ``parts`` + 256 rows.
    """
    cuts = docs.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], max(10_000, 4 * parts)).alias("q")).first().q if parts > 1 else []
    part = range_of(F.col(order), sorted(set(cuts or [])))
    placed = docs.withColumn("_part", F.when(F.col(order).isNull(), F.conv(F.substring(placed_key(order)[1], 1, 2), 16, 10).cast("int") - 256).otherwise(part))
    first = placed.groupBy("_part").agg(F.min(F.struct(*placed_key(order))).alias("_first"))
    whole = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("_part").over(whole.orderBy("_part")), F.max("_part").over(whole))
    ring = first.select(F.col("_part").alias("_of"), "_first", before.alias("_before"))
    # a range's first row, once, as the end of the range before
    key = F.struct(*placed_key(order))
    ends = (
        placed.join(F.broadcast(ring), (F.col("_part") == F.col("_of")) & key.eqNullSafe(F.col("_first")))
        .groupBy("_of").agg(*[F.first(c).alias(c) for c in docs.columns], F.first("_before").alias("_part"))
        .drop("_of").withColumn("_end", F.lit(1))
    )
    every = placed.withColumn("_end", F.lit(0)).unionByName(ends).repartition(parts, "_part")
    for name, c in carried.items():
        every = every.withColumn(name, c)
    w = Window.partitionBy("_part").orderBy("_end", *placed_order(order))
    out = every.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ["text", *carried]])
    return out.where("_end = 0").drop("_end", "_part")


def placed_key(order: str) -> list[Column]:
    return [F.col(order).alias("a"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("b")]


def placed_order(order: str) -> list[Column]:
    return [F.col(order).asc_nulls_first(), F.sha2(F.coalesce("text", F.lit("")), 256)]


def edited_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, text, sketch, edited, edited_sketch, next_sketch) for every row; the edited text ends as the next document begins."""
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(docs.count() // RANGE_ROWS, MOST_RANGES))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    near = with_next(rows, "id", {"sketch": sketch(F.col("text"))}, parts)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    return near.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))


def op8_fracminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_sketches(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_fracminhash": op8_fracminhash}
SQL: dict[str, str] = {}
