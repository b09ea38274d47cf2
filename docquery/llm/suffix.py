"""Operator 9: suffix-array dedup with a common-prefix interval tree.

Every window of ``length`` bytes belongs to the bucket of the smallest hash of
its GRAM-byte strings, so equal windows share a bucket.  Consecutive windows of
one bucket form a carrier: a stretch of text that holds them all.  Carriers
whose bucket holds nothing else cannot have a repeat and are dropped after one
count; carriers with equal text become one class, with its occurrences.  In
each bucket that is left, the suffixes that begin at the windows of all classes
are sorted into an enhanced suffix array, whose common-prefix array is scanned
with a stack for intervals of at least ``length`` bytes.  An interval whose
suffixes have different bytes to their left (or begin a carrier) is a maximal
repeat group with all its occurrences; other intervals are shifts of one.  The
spans of the groups are what is removed.

A bucket of more than ``bucket`` classes (a passage that very many different
texts share) is not collected: its windows are counted by four prime lanes of
31 bits with a partial aggregate instead, which finds the same windows.

Classes are equal by an XXH3 digest of the carrier's bytes, and prefixes that
are sorted by a hash are compared byte by byte afterwards.

``keep`` "none" marks every byte of every repeated window; "first" leaves the
first occurrence by (id, hash of the text, position).

Nulls: a null text is empty; null ids come first in the order.  Repeated rows
(equal id and text) are occurrences of their own for "none" and one document
for "first".  Ids may be of any type that has an order; ties are broken by a
hash of the text, then the position.  An empty table gives an empty one; a
very long text is a slice of its own in a task.  Columns may have any names;
one that is named like a result column is replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.llm.common import Scratch, fresh, quoted, table
from docquery.llm.kernels import byte_table, covered, digests, mix, prefix_hash, range_hash, released, rolling_hash, runs_of, slices, sound_hash, window_runs

GRAM = 64
CARRIER = 256
SUFFIXES = 100_000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): h tells rows of one id apart."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    return docs.select(quoted(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def id_type(docs: DataFrame) -> str:
    return docs.schema["id"].dataType.simpleString()


def carriers(docs: DataFrame, length: int, classed: bool = True) -> DataFrame:
    """(m, ch, times, id, h, lo, n): the carriers of all texts, without their bytes; ch is zero if not ``classed``."""
    gram = min(GRAM, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, off in slices(b, "text"):
                row = np.repeat(np.arange(part.num_rows), np.diff(off))
                valid = np.arange(len(data)) + length <= off[1:][row]
                v = byte_table(1)[data]
                m, lo, n, times = window_runs(rolling_hash(v, gram), row, valid, length - gram + 1, CARRIER)
                ch = digests(data.tobytes(), lo, lo + n + length - 1)[:, 0] if classed else np.zeros(len(lo), dtype=np.int64)
                of = row[lo]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(ch), pa.array(times.astype(np.int32)), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array((lo - off[of]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["m", "ch", "times", "id", "h", "lo", "n"],
                )

    return docs.select("id", "h", "text").mapInArrow(released(run), f"m long, ch long, times int, id {id_type(docs)}, h long, lo int, n int")


def intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Stack scan: (first, last, depth) of every maximal repeat group, shallower before deeper.

    lcp[i] is the common prefix of suffixes i and i + 1; left[i] is the byte
    before suffix i, or 256 where a carrier begins.  A group is an interval of
    suffixes with common prefixes of ``least`` or more whose left bytes
    differ; a stretch of suffixes that all follow the same byte has no group
    and is passed over without a scan.
    """
    change = np.zeros(len(left), dtype=np.int64)
    change[1:] = np.cumsum((left[1:] != left[:-1]) | (left[1:] == 256))
    open_ = left == 256
    starts, ends = runs_of(lcp >= least)
    out: list[tuple[int, int, int]] = []
    if not len(starts):
        return out
    diverse = (change[ends] > change[starts]) | open_[starts]
    cuts = np.stack([starts, ends], 1).ravel()[: 2 * len(starts) - int(ends[-1] == len(lcp))]
    low, top = np.minimum.reduceat(lcp, cuts)[::2], np.maximum.reduceat(lcp, cuts)[::2]
    flat = diverse & (low == top)
    out += zip(starts[flat].tolist(), ends[flat].tolist(), low[flat].tolist(), strict=True)
    deep = diverse & (low < top)
    for a, z in zip(starts[deep].tolist(), ends[deep].tolist(), strict=True):
        steps = change[a : z + 1].tolist()
        first = open_[a : z + 1].tolist()
        stack: list[tuple[int, int]] = []
        for i, d in enumerate([*lcp[a:z].tolist(), 0]):
            begin = i
            while stack and stack[-1][1] > d:
                begin, depth = stack.pop()
                if steps[i] > steps[begin] or first[begin]:
                    out.append((a + begin, a + i, depth))
            if d and (not stack or stack[-1][1] < d):
                stack.append((begin, d))
    out.sort(key=lambda t: t[2])
    return out


class SuffixArray:
    """Enhanced suffix array over the carriers of one or more buckets.

    It holds the suffixes that share their first ``least`` bytes with another
    of their bucket; these are ranked by a 128-bit hash of that prefix and,
    inside such an interval, by the bytes that follow.  Neighbours of equal
    hashes are compared byte by byte; were two to differ, all prefixes would
    be ranked by their bytes.
    """

    def __init__(self, texts: list[bytes], n: np.ndarray, bucket: np.ndarray, least: int) -> None:
        """n: windows of each carrier; bucket: its bucket's number."""
        self.data = data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        size = np.array([len(t) for t in texts])
        self.base = np.cumsum(size) - size
        carrier = np.repeat(np.arange(len(texts)), n)
        offset = np.arange(len(carrier)) - np.repeat(np.cumsum(n) - n, n)
        start = self.base[carrier] + offset
        h = range_hash(prefix_hash(byte_table(21)[data]), start, start + least) ^ mix(bucket[carrier].astype(np.uint64))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        carrier, offset, start, h = carrier[order], offset[order], start[order], h[order]
        have = size[carrier] - offset - least
        width = int(have.max()) if len(have) else 0
        padded = np.concatenate([data, np.zeros(width + 1, dtype=np.uint8)])
        keys = np.empty((len(start), width + 17), dtype=np.uint8)
        keys[:, :8] = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        keys[:, 8:16] = range_hash(prefix_hash(byte_table(22)[data]), start, start + least).astype(">u8").view(np.uint8).reshape(-1, 8)
        keys[:, 16:] = np.lib.stride_tricks.sliding_window_view(padded, width + 1)[start + least]
        keys[:, 16:][np.arange(width + 1) >= have[:, None]] = 0
        order = np.argsort(keys.view(f"S{width + 17}").ravel(), kind="stable")
        if len(start) and not self._prefixes_agree(start[order], keys[order, :16], least):
            prefix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, least)[start]).view(f"S{least}").ravel()
            keys[:, 8:16] = np.unique(prefix, return_inverse=True)[1].astype(">u8").view(np.uint8).reshape(-1, 8)
            order = np.argsort(keys.view(f"S{width + 17}").ravel(), kind="stable")
        self.carrier, self.offset, self.start, have = carrier[order], offset[order], start[order], have[order]
        keys = keys[order]
        differ = keys[1:] != keys[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width + 17) - 16
        self.lcp = np.where(common < 0, 0, least + np.minimum(np.maximum(common, 0), np.minimum(have[1:], have[:-1])))
        #: The byte to the left; 256 at a carrier's begin, which differs from every other.
        self.left = np.where(self.offset > 0, data[np.maximum(self.start - 1, 0)].astype(np.int16), 256)


    def _prefixes_agree(self, start: np.ndarray, ranks: np.ndarray, least: int, at_once: int = 1 << 14) -> bool:
        """Whether neighbours of one rank have the same first ``least`` bytes."""
        view = np.lib.stride_tricks.sliding_window_view(self.data, least)
        same = np.flatnonzero((ranks[1:] == ranks[:-1]).all(1))
        return all((view[start[x]] == view[start[x + 1]]).all() for x in np.split(same, range(at_once, len(same), at_once)))


def _lists(sa: SuffixArray, cover: np.ndarray, n_carriers: int) -> pa.Array:
    """For each carrier the union of [offset, offset + cover), as start, end, start, end."""
    own = np.flatnonzero(cover)
    mask = covered(len(sa.data), sa.start[own], cover[own])
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    begin[sa.base] |= mask[sa.base]
    a = np.flatnonzero(begin)
    stop = mask.copy()
    stop[:-1] &= ~mask[1:]
    stop[sa.base[1:] - 1] |= mask[sa.base[1:] - 1]
    z = np.flatnonzero(stop) + 1
    of = np.searchsorted(sa.base, a, side="right") - 1
    flat = (np.stack([a, z], axis=1) - sa.base[of][:, None]).ravel().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array((2 * np.searchsorted(of, np.arange(n_carriers + 1))).astype(np.int32)), pa.array(flat))


def _spans(sa: SuffixArray, n_carriers: int, rank: np.ndarray, least: int, groups: bool) -> tuple[pa.Array, pa.Array, list[list[tuple[int, int, int]]]]:
    """For each carrier: byte spans in repeats, spans in repeats that begin earlier elsewhere, and its places in groups."""
    every, later = np.zeros(len(sa.carrier), dtype=np.int64), np.zeros(len(sa.carrier), dtype=np.int64)
    place = rank[sa.carrier] * (1 << 20) + sa.offset
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n_carriers)]
    for a, z, depth in intervals(sa.lcp, sa.left, least):
        every[a : z + 1] = depth
        first = a + int(place[a : z + 1].argmin())
        before = later[first]
        later[a : z + 1] = depth
        later[first] = before
        if groups:
            gid = int.from_bytes(hashlib.blake2b(sa.data[sa.start[a] : sa.start[a] + depth].tobytes(), digest_size=8).digest(), "little", signed=True)
            for i in range(a, z + 1):
                found[sa.carrier[i]].append((gid, depth, int(sa.offset[i])))
    return _lists(sa, every, n_carriers), _lists(sa, later, n_carriers), found


GROUPS = "array<struct<gid:long,size:int,at:int>>"


def bucket_repeats(parts: DataFrame, length: int, groups: bool) -> DataFrame:
    """parts(m, ch, rank columns, n, text binary), whole buckets in a partition and sorted -> (m, ch, every, later, groups)."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        m = t.column("m").to_numpy()
        bucket = np.cumsum(np.concatenate([[0], (m[1:] != m[:-1]).astype(np.int64)]))
        n = t.column("n").to_numpy().astype(np.int64)
        # rows come sorted by the order of first occurrences inside a bucket
        sa = SuffixArray(t.column("text").to_pylist(), n, bucket, length)
        every, later, found = _spans(sa, len(m), np.arange(len(m)), length, groups)
        kind = pa.list_(pa.struct([("gid", pa.int64()), ("size", pa.int32()), ("at", pa.int32())]))
        return pa.RecordBatch.from_arrays([
            t.column("m").combine_chunks(), t.column("ch").combine_chunks(), every, later,
            pa.array([[{"gid": g, "size": d, "at": o} for g, d, o in x] for x in found], kind),
        ], names=["m", "ch", "every", "later", "groups"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            held.append(b)
            count += int(np.sum(b.column(b.schema.get_field_index("n")).to_numpy()))
            if count >= SUFFIXES:
                t = pa.Table.from_batches(held).combine_chunks()
                m = t.column("m").to_numpy()
                n = np.cumsum(t.column("n").to_numpy())
                begin, last = 0, int(np.searchsorted(m, m[-1]))
                while begin < last:  # whole buckets, about SUFFIXES at a time
                    want = (n[begin - 1] if begin else 0) + SUFFIXES
                    stop = min(int(np.searchsorted(n, want)) + 1, last)
                    stop = int(np.searchsorted(m, m[stop - 1], side="right"))
                    yield solve(t.slice(begin, stop - begin))
                    begin = stop
                held = t.slice(begin).to_batches()
                count = int(n[-1] - (n[begin - 1] if begin else 0)) if begin < len(n) else 0
                if not begin:
                    count = 0  # one bucket so far; look again after as many more
        if held and sum(b.num_rows for b in held):
            t = pa.Table.from_batches(held).combine_chunks()
            m, n = t.column("m").to_numpy(), np.cumsum(t.column("n").to_numpy())
            begin = 0
            while begin < len(m):
                want = (n[begin - 1] if begin else 0) + SUFFIXES
                stop = min(int(np.searchsorted(n, want)) + 1, len(m))
                stop = int(np.searchsorted(m, m[stop - 1], side="right"))
                yield solve(t.slice(begin, stop - begin))
                begin = stop

    return parts.mapInArrow(released(run), f"m long, ch long, every array<int>, later array<int>, groups {GROUPS}")


def wide_bucket_repeats(parts: DataFrame, length: int) -> DataFrame:
    """The same spans for buckets too large for one task, from counts of window hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = b.column("text").to_pylist(), b.column("n").to_numpy().astype(np.int64)
            for i in range(0, b.num_rows, 512):
                data = np.frombuffer(b"".join(texts[i : i + 512]), dtype=np.uint8)
                size, k = np.array([len(t) for t in texts[i : i + 512]]), n[i : i + 512]
                of = np.repeat(np.arange(len(size)), k)
                o = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
                s = (np.cumsum(size) - size)[of] + o
                w = [sound_hash(data, s, s + length, x).view(np.int64) for x in ((21, 22), (23, 24))]
                at = pa.array(of + i)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("m", "ch", "id", "h", "lo")), pa.array(o.astype(np.int32)), pa.array(w[0]), pa.array(w[1])], names=["m", "ch", "id", "h", "lo", "o", "w1", "w2"])

    rows = parts.mapInArrow(released(cut), f"m long, ch long, id {id_type(parts)}, h long, lo int, o int, w1 long, w2 long")
    same = rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "h", "lo", "ch", "o")).alias("first")).where("c > 1")
    hit = rows.join(same, ["w1", "w2"]).select("m", "ch", "o", (F.col("ch").eqNullSafe(F.col("first.ch")) & (F.col("o") == F.col("first.o"))).alias("is_first"))
    spans = lambda c: F.flatten(F.transform(F.array_sort(c), lambda o: F.array(o, o + length)))
    return hit.groupBy("m", "ch").agg(spans(F.collect_list("o")).alias("every"), spans(F.collect_list(F.when(~F.col("is_first"), F.col("o")))).alias("later"), F.array().cast(GROUPS).alias("groups"))


def repeats(docs: DataFrame, scratch: Scratch, length: int = 200, bucket: int = 2048, groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs(id, h, text) -> candidate carriers (m, ch, id, h, lo, n), and classes (m, ch, c, first, every, later, groups) of the repeated ones."""
    rows = carriers(docs, length)
    known = carriers(docs, length, False).groupBy("m").agg(F.sum("times").alias("t")).where("t > 1").select("m")
    known = scratch.cut(known)
    cand = scratch.cut(rows.join(known.hint("shuffle_hash"), "m", "left_semi"))
    classes = cand.groupBy("m", "ch").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "h", "lo")).alias("first"), F.first("n").alias("n"), F.max("times").alias("times"))
    classes = scratch.cut(classes)
    per = scratch.cut(classes.groupBy("m").agg(F.count(F.lit(1)).alias("classes"), F.max("times").alias("most")).where("classes > 1 or most > 1").select("m", "classes"))
    wanted = classes.join(per, "m").select("m", "ch", "n", "classes", F.col("first.id").alias("id"), F.col("first.h").alias("h"), F.col("first.lo").alias("lo"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each wanted carrier of a document."""
        for b in batches:
            for part, data, off in slices(b, "text"):
                want = part.column(part.schema.get_field_index("want"))
                flat, size = want.flatten(), np.diff(want.offsets.to_numpy())
                of = np.repeat(np.arange(part.num_rows), size)
                lo, n = (flat.field(x).to_numpy().astype(np.int64) for x in ("lo", "n"))
                start = off[of] + lo
                texts = [data[a:z].tobytes() for a, z in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                ids = pa.array(of)
                yield pa.RecordBatch.from_arrays([flat.field("m"), flat.field("ch"), flat.field("n"), flat.field("classes"), part.column(0).take(ids), part.column(1).take(ids), flat.field("lo"), pa.array(texts, pa.binary())], names=["m", "ch", "n", "classes", "id", "h", "lo", "text"])

    lists = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("m", "ch", "n", "classes", "lo")).alias("want"))
    one = docs.join(lists.withColumnsRenamed({"id": "id_", "h": "h_"}), F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")))
    parts = scratch.cut(one.select("id", "h", "text", "want").mapInArrow(released(fetch), f"m long, ch long, n int, classes long, id {id_type(docs)}, h long, lo int, text binary").dropDuplicates(["m", "ch"]))
    small = parts.where(F.col("classes") <= bucket).repartition("m").sortWithinPartitions("m", F.col("id").asc_nulls_first(), "h", "lo")
    solved = bucket_repeats(small.select("m", "ch", "n", "text"), length, groups)
    wide = parts.where(F.col("classes") > bucket)
    if wide.limit(1).count():
        solved = solved.union(wide_bucket_repeats(wide, length))
    solved = solved.where("size(every) > 0")
    out = classes.select("m", "ch", "c", "first", "n").join(solved, ["m", "ch"], "left").where("c > 1 or every is not null")
    return cand, scratch.cut(out)


def document_spans(cand: DataFrame, classes: DataFrame, length: int, keep: str) -> DataFrame:
    """(id, h, spans): byte spans to remove, as start, end, start, end."""
    whole = F.array(F.lit(0), F.col("n") + (length - 1))
    if keep == "first":
        is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")) & (F.col("lo") == F.col("first.lo"))
        spans = F.when(~is_first, whole).otherwise(F.coalesce("later", F.array().cast("array<int>")))
    else:
        spans = F.when(F.col("c") > 1, whole).otherwise(F.col("every"))
    rows = cand.select("m", "ch", "id", "h", "lo").join(classes.drop("groups").hint("shuffle_hash"), ["m", "ch"]).select("id", "h", F.transform(spans, lambda x: x + F.col("lo")).alias("s")).where("size(s) > 0")
    return rows.groupBy("id", "h").agg(F.flatten(F.collect_set("s")).alias("spans"))


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep: str = "none", bucket: int = 2048, as_text: bool = False, kept_col: str = "_kept", spans_col: str = "_spans") -> DataFrame:
    """docs with ``kept_col``, every row's remaining bytes (``as_text``: as a string, without the rest of characters that a span cuts), and ``spans_col``, the maximal removed runs of bytes as start, end, start, end."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep!r}")
    since = scratch.count
    rows = keyed(docs, id_col, text_col)
    cand, classes = repeats(rows, scratch, length, bucket)
    spans = scratch.cut(document_spans(cand, classes, length, keep))
    scratch.prune(since, spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, spans = b.column(b.num_columns - 2).cast(pa.binary()), b.column(b.num_columns - 1)
            kept, runs = [], []
            for t, s in zip(raw, spans, strict=True):
                t = t.as_py()
                if not s.is_valid:
                    kept.append(t)
                    runs.append([])
                    continue
                s = s.values.to_numpy().astype(np.int64)
                gone = covered(len(t), s[::2], s[1::2] - s[::2])
                a, z = runs_of(gone)
                kept.append(np.frombuffer(t, dtype=np.uint8)[~gone].tobytes())
                runs.append(np.stack([a, z], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 2)), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.int32()))], names=[*b.schema.names[:-2], kept_col, spans_col])

    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    i, h, i2, h2, text_, spans_ = fresh(docs, "i", "h", "i2", "h2", "whole", "spans")
    given = docs.select("*", quoted(id_col).alias(i), F.xxhash64(text).alias(h), text.alias(text_))
    both = given.join(spans.select(F.col("id").alias(i2), F.col("h").alias(h2), F.col("spans").alias(spans_)), F.col(i).eqNullSafe(F.col(i2)) & (F.col(h) == F.col(h2)), "left")
    carried = [f for f in docs.schema.fields if f.name not in (kept_col, spans_col)]
    schema = T.StructType([*carried, T.StructField(kept_col, T.StringType() if as_text else T.BinaryType()), T.StructField(spans_col, T.ArrayType(T.IntegerType()))])
    return both.select(*[quoted(f.name) for f in carried], text_, spans_).mapInArrow(released(cut), schema)


def repeat_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(gid, size, id, h, start): every occurrence of every maximal repeat group, repeats longer than a carrier as overlapping groups."""
    cand, classes = repeats(keyed(docs, id_col, text_col), scratch, length, 1 << 30, True)
    own = F.when(F.size(F.coalesce("groups", F.array().cast(GROUPS))) > 0, F.col("groups")).otherwise(F.array(F.struct(F.col("ch").alias("gid"), (F.col("n") + length - 1).cast("int").alias("size"), F.lit(0).alias("at"))))
    groups = classes.select("m", "ch", F.explode(own).alias("g"))
    return cand.join(groups, ["m", "ch"]).select("g.gid", "g.size", "id", "h", (F.col("lo") + F.col("g.at")).alias("start"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op9"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("_kept")).alias("n_removed"), (F.size("_spans") / 2).cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_suffix_array": op9_suffix_array}
SQL: dict[str, str] = {}
