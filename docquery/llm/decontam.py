"""Operator 1: benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of ``size`` words (an item of fewer
words is one window).  The shingles of the windows are counted over all
documents; each window's shingles are ordered by rarity and its rarest one is
its necessary prefix: a document without it cannot contain the window.  The
prefixes form an index that every document's shingles are joined against; a
match must pass the positional bound (the window would begin inside the text)
and the length bound (and end inside it), and is then verified word by word.

The benchmark is the query set.  It is streamed in blocks of at most
``block_bytes`` of text (a longer item is a block of its own); one block's
index is broadcast at a time.  Documents pass through once for each block,
without a shuffle, so that neither a frequent passage nor a hot source can
load one task.  Of more blocks than one, the hits of each are written, and put
together by document at the end.

Nulls: a null document or item has no words; a null item id is listed as an
empty string.  Repeated items are listed with all their ids; repeated
documents, and documents of one id (ties), each get their row.  An empty
benchmark leaves all documents clean, an empty table of documents gives an
empty one.  A long text is a slice of its own in a task; windows lie anywhere
in it.  Columns other than those named are carried as they are, or not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.llm.common import Scratch, quoted, table
from docquery.llm.kernels import PUNCTUATION, byte_table, expand, lower_ascii, prefix_hash, range_hash, released, rolling_hash, row_of, slices, words

SHINGLE = 3
HITS = "array<struct<item:string,start:int,end:int>>"


def _tokens(text: str | None) -> list[bytes]:
    data = lower_ascii(np.frombuffer((text or "").encode(), dtype=np.uint8))
    s, e, _ = words(data, np.array([0, len(data)]), PUNCTUATION)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(byte_table(3)[data]), starts, ends)


def _list_hash(tokens: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    return _hashes(data, ends - [len(t) for t in tokens], ends)


class Index:
    """Windows of one block of items; ``prefixes`` by shingle size once the counts are known."""

    def __init__(self, items: list[tuple[str, str | None]], size: int) -> None:
        self.windows: list[bytes] = []
        self.lengths: list[int] = []
        self.items: list[dict[str, None]] = []
        self.shingles: list[np.ndarray] = []
        seen: dict[bytes, int] = {}
        for item, text in items:
            tokens = _tokens(text)
            if not tokens:
                continue
            n = min(size, len(tokens))
            h = _list_hash(tokens)
            s = min(SHINGLE, n)
            shingles = rolling_hash(h, s)
            for p in range(len(tokens) - n + 1):
                key = b" ".join(tokens[p : p + n])
                if key not in seen:
                    seen[key] = len(self.windows)
                    self.windows.append(key)
                    self.lengths.append(n)
                    self.items.append({})
                    self.shingles.append(shingles[p : p + n - s + 1])
                self.items[seen[key]][item] = None

    def by_size(self) -> dict[int, np.ndarray]:
        """Distinct shingle hashes for each shingle size in use."""
        out: dict[int, set[int]] = {}
        for n, s in zip(self.lengths, self.shingles, strict=True):
            out.setdefault(min(SHINGLE, n), set()).update(s.tolist())
        return {k: np.array(sorted(v), dtype=np.uint64) for k, v in out.items()}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep for each window its rarest shingle (ties by hash) and where it stands in the window."""
        chosen: dict[int, list[tuple[int, int, int]]] = {}
        for w, (n, s) in enumerate(zip(self.lengths, self.shingles, strict=True)):
            k = min(SHINGLE, n)
            at, h = min(enumerate(s.tolist()), key=lambda x: (counts.get((k, x[1]), 0), x[1], x[0]))
            chosen.setdefault(k, []).append((h, w, at))
        self.prefixes = {}
        for k, v in chosen.items():
            v.sort()
            self.prefixes[k] = (np.array([x[0] for x in v], dtype=np.uint64), np.array([x[1] for x in v]), np.array([x[2] for x in v]))
        self.n = np.array(self.lengths)
        self.shingles = []


def _count(docs: DataFrame, shared) -> DataFrame:
    """(k, h, n): occurrences over all documents of the shingles of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = {k: np.zeros(len(v), dtype=np.int64) for k, v in wanted.items()}
        for b in batches:
            for _, data, off in slices(b, "text"):
                data = lower_ascii(data)
                s, e, rows = words(data, off, PUNCTUATION)
                h, row = _hashes(data, s, e), row_of(rows, len(s))
                for k, v in wanted.items():
                    roll = rolling_hash(h, k)
                    roll = roll[row[: len(roll)] == row[k - 1 :]] if len(roll) else roll
                    at = np.searchsorted(v, roll)
                    at[at == len(v)] = 0
                    total[k] += np.bincount(at[v[at] == roll], minlength=len(v)) if len(v) else 0
        for k, v in wanted.items():
            own = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, dtype=np.int32)), pa.array(v[own].view(np.int64)), pa.array(total[k][own])], names=["k", "h", "n"])

    return docs.select("text").mapInArrow(released(run), "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))


def _merge(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Join overlapping and touching spans of one item."""
    out: list[tuple[str, int, int]] = []
    for item, a, b in sorted(spans):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((item, a, b))
    return out


def without(raw: bytes, s: np.ndarray, e: np.ndarray, spans: list[dict]) -> str:
    """A text without the words of the spans and what stands between them; s and e are its words' bounds."""
    out, last = [], 0
    for _, a, z in _merge([("", x["start"], x["end"]) for x in spans]):
        out.append(raw[last : s[a]])
        last = int(e[z - 1])
    return b"".join([*out, raw[last:]]).decode()


def _probe(docs: DataFrame, shared, clean: bool) -> DataFrame:
    """(..., text, n_words, hits) -> the same with n_words set and the hits of one block appended; ``clean`` adds the text without all hits, where it has any."""
    schema = T.StructType([*docs.schema.fields, *[T.StructField("clean", T.StringType())] * clean])
    hits_type = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            for part, raw, off in slices(b, "text"):
                data = lower_ascii(raw)
                s, e, rows = words(data, off, PUNCTUATION)
                h, row = _hashes(data, s, e), row_of(rows, len(s))
                found: dict[int, list[tuple[str, int, int]]] = {}
                for k, (keys, window, offset) in index.prefixes.items():
                    roll = rolling_hash(h, k)
                    lo = np.searchsorted(keys, roll)
                    n = np.searchsorted(keys, roll, side="right") - lo
                    at = np.flatnonzero(n)
                    entry = expand(lo[at], n[at])
                    start = np.repeat(at, n[at]) - offset[entry]
                    end = start + index.n[window[entry]]
                    doc = row[np.repeat(at, n[at])]
                    ok = (start >= rows[doc]) & (end <= rows[doc + 1])
                    for p, q, w, r in zip(start[ok].tolist(), end[ok].tolist(), window[entry][ok].tolist(), doc[ok].tolist(), strict=True):
                        if b" ".join([data[x:y].tobytes() for x, y in zip(s[p:q].tolist(), e[p:q].tolist(), strict=True)]) == index.windows[w]:
                            base = int(rows[r])
                            found.setdefault(r, []).extend((item, p - base, q - base) for item in index.items[w])
                hits = part.column(part.num_columns - 1)
                if found:
                    hits = hits.to_pylist()
                    for r, spans in found.items():
                        hits[r] = (hits[r] or []) + [{"item": i, "start": a, "end": z} for i, a, z in _merge(spans)]
                    hits = pa.array(hits, type=hits_type)
                more = []
                if clean:
                    texts: list[str | None] = [None] * part.num_rows
                    for r in np.flatnonzero(np.diff(hits.offsets.to_numpy())).tolist():
                        own = slice(int(rows[r]), int(rows[r + 1]))
                        texts[r] = without(raw[off[r] : off[r + 1]].tobytes(), s[own] - off[r], e[own] - off[r], hits[r].as_py())
                    more.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 2)), pa.array(np.diff(rows)), hits, *more], names=[*part.schema.names, *["clean"] * clean])

    return docs.mapInArrow(released(run), schema)


def blocks(items: Iterator, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    held, size = [], 0
    for item, text in items:
        n = len((text or "").encode())
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += n
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, block_bytes: int = 4 << 20, carried: list[str] | None = None, clean: bool = False) -> DataFrame:
    """(id, row, text, n_words, hits, clean), row with the columns ``carried``, clean the text without its hits: for every document the word spans that occurrences of each item's windows cover."""
    spark = docs.sparkSession
    source = docs.select(quoted(id_col).alias("id"), *([F.struct(*map(quoted, carried)).alias("row")] if carried else []), quoted(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(HITS).alias("hits"))
    items = benchmark.select(F.coalesce(quoted(item_col).cast("string"), F.lit("")), quoted(item_text_col).cast("string")).toLocalIterator()
    held = blocks(items, block_bytes)

    def index_of(block: list[tuple[str, str | None]]) -> Index:
        index = Index(block, size)
        wanted = spark.sparkContext.broadcast(index.by_size())
        counts = {(r.k, r.h % (1 << 64)): r.n for r in _count(source, wanted).collect()} if index.windows else {}
        wanted.unpersist()
        index.order(counts)
        return index

    block, after = next(held, []), next(held, None)
    if after is None:
        return _probe(source, spark.sparkContext.broadcast(index_of(block)), clean)
    scratch, parts = Scratch(spark, "hits"), []
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    while block is not None:
        shared = spark.sparkContext.broadcast(index_of(block))
        found = _probe(source.select("id", key, "text", "n_words", "hits"), shared, False).where("size(hits) > 0")
        parts.append(scratch.cut(found.select("id", "h", "hits").dropDuplicates(["id", "h"])))
        shared.unpersist()
        block, after = after, next(held, None)
    every = reduce(DataFrame.union, parts).groupBy("id", "h").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    every = scratch.cut(every.select(F.col("id").alias("id_"), F.col("h").alias("h_"), F.col("hits").alias("found")))
    scratch.prune(0, every)
    rows = source.join(every, F.col("id").eqNullSafe(F.col("id_")) & (key == F.col("h_")), "left")
    rows = rows.select(*source.columns[:-1], F.coalesce("found", "hits").alias("hits"))
    # no index: counts the words, and cuts the hits
    return _probe(rows, spark.sparkContext.broadcast(index_of([])), clean)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return digest(found)


def digest_columns() -> dict[str, Column]:
    """n_hit, items and contaminated from n_words and hits."""
    n_hit = F.expr("""aggregate(array_sort(transform(hits, h -> struct(h.start as s, h.end as e))), struct(0 as e, 0L as n),
        (a, x) -> struct(greatest(a.e, x.e) as e, a.n + greatest(0, x.e - greatest(a.e, x.s)) as n), a -> a.n)""")
    return {"n_hit": n_hit, "items": F.array_sort(F.array_distinct(F.col("hits.item"))), "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("n_words"))}


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans."""
    c = digest_columns()
    return found.select(
        F.col("id").alias("doc_id"), "n_words", c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"),
        c["contaminated"].alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_decontamination": op1_decontamination}
SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bp AS (SELECT item, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM bp),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
dw AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s FROM dp),
hit AS (SELECT DISTINCT doc_id, k, p, item FROM dw JOIN bw USING (k, s)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, k, p FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
