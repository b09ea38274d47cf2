"""Operator 10: substring dedup with fixed-block anchors.

A window of ``length`` words that starts in a document with a smaller id, too,
holds one whole block of that document's non-overlapping blocks of
``(length + 1) // 2`` words.  Blocks are indexed by hash with the smallest id
that has each; every rolling block-sized stretch of words probes the index,
and a hit in a smaller document anchors a repeat.  Hits are extended to
maximal exact repeats: of every window around a hit, and around each block
that was hit, 96 bits of an XXH3 digest of its words are compared over all
documents, so a repeat is found wherever its first copy stands and not only in
the anchor's document.  Polynomial hashes only select what is hit or digested.

Before the index is built, probes that nothing can answer are dropped and
copies are collapsed: windows are cut into runs by the minimum of their
GRAM-word shingle hashes, and only runs whose minimum stands twice can repeat.
Runs of equal words are a class; all its members but those with the smallest
id are repeats as a whole, and only members with the smallest id are indexed
and probe for the windows that it shares with other classes.  This spares the
shuffle of all rolling stretches of all texts, and drops no repeat.

Documents without an id come after all others and do not repeat one another,
and neither do rows of one id (ties; 2**63 - 1 ties with no id).  Ids are
integers, or else ordered as strings.  A null or empty text has no words, a repeated row its own row of the
result; an empty table gives an empty one.  A very long text is a slice of its
own in a task.  Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.llm.common import Scratch, quoted, table
from docquery.llm.kernels import SPACE, byte_table, covered, digests, joined, prefix_hash, range_hash, released, rolling_hash, row_of, runs_of, slices, window_runs, words

GRAM = 5
RUN = 256
#: Stand for a missing id: nothing comes after them.
LAST, LAST_TEXT = (1 << 63) - 1, "\U0010ffff" * 4


def hashed(data: np.ndarray, off: np.ndarray, seed: int = 31) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row boundaries, row and hash of every word."""
    s, e, rows = words(data, off, SPACE)
    return s, e, rows, row_of(rows, len(s)), range_hash(prefix_hash(byte_table(seed)[data]), s, e)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): id is LAST where there is none; h tells rows of one id apart, and is odd where there is no id."""
    key, text = quoted(id_col), F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    given = F.coalesce(key.cast("long"), F.lit(LAST)) if whole else F.coalesce(key.cast("string"), F.lit(LAST_TEXT))
    return docs.select(given.alias("id"), F.shiftleft(F.hash(text), 1).bitwiseOR(key.isNull().cast("int")).alias("h"), text.alias("text"))


def id_type(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def runs(docs: DataFrame, length: int) -> DataFrame:
    """(m, times, id, lo, n): runs of windows by the minimum of their shingle hashes."""
    gram = min(GRAM, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, off in slices(b, "text"):
                s, _, rows, row, h = hashed(data, off)
                valid = np.arange(len(s)) + length <= rows[1:][row]
                m, lo, n, times = window_runs(rolling_hash(h, gram), row, valid, length - gram + 1, RUN)
                of = row[lo]
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(times.astype(np.int32)), part.column(0).take(pa.array(of)), pa.array((lo - rows[of]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["m", "times", "id", "lo", "n"])

    return docs.select("id", "text").mapInArrow(released(run), f"m long, times int, id {id_type(docs)}, lo int, n int")


def short(w: np.ndarray) -> np.ndarray:
    return (w >> 32).astype(np.int32)


def classes(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """found(m, id, lo, n) -> (m, w1, w2, id, h, lo, n) with 96 bits of a digest of each run's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                s, e, rows = words(data, off, SPACE)
                raw, s, e = joined(data, s, e)
                want = part.column(3)
                flat, size = want.flatten(), np.diff(want.offsets.to_numpy())
                of = np.repeat(np.arange(part.num_rows), size)
                lo, n = (flat.field(x).to_numpy().astype(np.int64) for x in ("lo", "n"))
                # runs of other rows of the same id may lie outside this text
                own = np.flatnonzero(lo + n + length - 1 <= np.diff(rows)[of])
                start = (rows[of] + lo)[own]
                w = digests(raw, s[start], e[start + n[own] + length - 2])
                at, take = pa.array(own), pa.array(of[own])
                yield pa.RecordBatch.from_arrays([flat.field("m").take(at), pa.array(w[:, 0]), pa.array(short(w[:, 1])), part.column(0).take(take), part.column(1).take(take), flat.field("lo").take(at), flat.field("n").take(at)], names=["m", "w1", "w2", "id", "h", "lo", "n"])

    return with_lists(docs, found, F.struct("m", "lo", "n")).mapInArrow(released(run), f"m long, w1 long, w2 int, id {id_type(docs)}, h int, lo int, n int")


def with_lists(docs: DataFrame, rows: DataFrame, item: Column) -> DataFrame:
    """Documents that have rows, with the rows' items as a list."""
    lists = rows.groupBy("id").agg(F.collect_set(item).alias("list"))
    return docs.join(lists, "id").select("id", "h", "text", "list")


def stretches(docs: DataFrame, regions: DataFrame, length: int, block: int) -> DataFrame:
    """(b, id, q): the hash of every rolling block-sized stretch of words inside the regions (id, lo, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                s, _, rows, row, h = hashed(data, off)
                want = part.column(3)
                flat, size = want.flatten(), np.diff(want.offsets.to_numpy())
                of = np.repeat(np.arange(part.num_rows), size)
                lo, n = (flat.field(x).to_numpy().astype(np.int64) for x in ("lo", "n"))
                # regions of other rows of the same id may lie outside this text
                n = np.minimum(n + length - 1, np.maximum(np.diff(rows)[of] - lo, 0))
                inside = covered(len(s), rows[of] + lo, n) if len(of) else np.zeros(len(s), dtype=bool)
                roll = rolling_hash(h, block)
                k = len(roll)
                ok = np.flatnonzero(inside[:k] & inside[len(s) - k :] & (row[:k] == row[len(s) - k :])) if k else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(roll[ok].view(np.int64)), part.column(0).take(pa.array(row[ok])), pa.array((ok - rows[row[ok]]).astype(np.int32))], names=["b", "id", "q"])

    return with_lists(docs, regions, F.struct("lo", "n")).mapInArrow(released(run), f"b long, id {id_type(docs)}, q int")


def windows(docs: DataFrame, anchors: DataFrame, length: int, block: int) -> DataFrame:
    """(w1, w2, id, h, p): the hash of every window that holds an anchor (id, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                s, e, rows = words(data, off, SPACE)
                row = row_of(rows, len(s))
                raw, s, e = joined(data, s, e)
                want = part.column(3)
                of = np.repeat(np.arange(part.num_rows), np.diff(want.offsets.to_numpy()))
                q = want.flatten().to_numpy().astype(np.int64)
                first = np.maximum(q - (length - block), 0)
                last = np.minimum(q, np.diff(rows)[of] - length)
                ok = last >= first
                near = covered(len(s), (rows[of] + first)[ok], (last - first + 1)[ok]) if ok.any() else np.zeros(len(s), dtype=bool)
                p = np.flatnonzero(near)
                w = digests(raw, s[p], e[p + length - 1])
                at = row[p]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(short(w[:, 1])), part.column(0).take(take), part.column(1).take(take), pa.array((p - rows[at]).astype(np.int32))], names=["w1", "w2", "id", "h", "p"])

    return with_lists(docs, anchors, F.col("q")).mapInArrow(released(run), f"w1 long, w2 int, id {id_type(docs)}, h int, p int")


def repeated_windows(docs: DataFrame, scratch: Scratch, length: int = 13) -> DataFrame:
    """docs(id, h, text) -> (id, h, p, n): runs of n windows that start in a document with a smaller id, too."""
    block, since = (length + 1) // 2, scratch.count
    rows = runs(docs, length)
    known = scratch.cut(rows.groupBy("m").agg(F.sum("times").alias("t")).where("t > 1").select("m"))
    found = scratch.cut(rows.select("m", "id", "lo", "n").join(known.hint("shuffle_hash"), "m", "left_semi"))
    found = scratch.cut(classes(docs, found, length))
    key = ["w1", "w2"]
    first = scratch.cut(found.groupBy(*key).agg(F.min("id").alias("a"), F.first("m").alias("m")))
    several = first.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m")
    copies = scratch.cut(found.join(first.select(*key, "a").hint("shuffle_hash"), key).select("m", "id", "h", F.col("lo").alias("p"), "n", "a"))
    whole = copies.where("a < id").select("id", "h", "p", "n")
    regions = scratch.cut(copies.where("a = id").join(several, "m", "left_semi").select("id", F.col("p").alias("lo"), "n"))

    probes = scratch.cut(stretches(docs, regions, length, block))
    index = probes.groupBy("b").agg(F.min(F.when(F.col("q") % block == 0, F.col("id"))).alias("ref"), F.max("id").alias("top")).where("ref < top").select("b", "ref")
    index = scratch.cut(index)
    hit = (F.col("ref") < F.col("id")) | (F.col("q") % block == 0)
    anchors = scratch.cut(probes.join(index.hint("shuffle_hash"), "b").where(hit).select("id", "q"))
    scratch.drop(probes)

    found = scratch.cut(windows(docs, anchors, length, block))
    least = scratch.cut(found.groupBy(*key).agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select(*key, "a"))
    part = scratch.cut(found.join(least.hint("shuffle_hash"), key).where("a < id").select("id", "h", "p", F.lit(1).alias("n")))
    scratch.prune(since, copies, part)
    return whole.union(part)


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """(id, n_words, n_removed, kept, spans) for every row; kept words are joined by single spaces, spans are word runs removed, as start, end."""
    rows = keyed(docs, id_col, text_col)
    gone = repeated_windows(rows, scratch, length).groupBy("id", "h").agg(F.collect_set(F.struct("p", "n")).alias("list"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                s, e, bounds = words(data, off, SPACE)
                want = part.column(2).fill_null([]) if part.column(2).null_count else part.column(2)
                of = np.repeat(np.arange(part.num_rows), np.diff(want.offsets.to_numpy()))
                flat = want.flatten()
                p, n = (flat.field(x).to_numpy().astype(np.int64) for x in ("p", "n"))
                mask = covered(len(s), bounds[of] + p, n + length - 1) if len(p) else np.zeros(len(s), dtype=bool)
                raw = data.tobytes()
                kept, spans, removed = [], [], []
                for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    m = mask[a:z]
                    left = np.flatnonzero(~m) + a
                    kept.append(b" ".join([raw[x:y] for x, y in zip(s[left].tolist(), e[left].tolist(), strict=True)]))
                    removed.append(z - a - len(left))
                    spans.append(np.stack(runs_of(m), axis=1).ravel().tolist() if removed[-1] else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.int32()))], names=["id", "n_words", "n_removed", "kept", "spans"])

    both = rows.join(gone, ["id", "h"], "left").select(F.when(F.col("h") % 2 == 0, F.col("id")).alias("id"), "text", "list")
    return both.mapInArrow(released(cut), f"id {id_type(rows)}, n_words long, n_removed long, kept string, spans array<int>")


def op10_fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_fixed_blocks": op10_fixed_blocks}
SQL: dict[str, str] = {
    "op10_fixed_blocks": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM p),
least_ AS (SELECT s, min(doc_id) AS a FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN least_ USING (s) WHERE a < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM d),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.q) AS t, count(*) AS n FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
}
