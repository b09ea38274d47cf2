"""Operator 5: SimHash near-dedup with BK-trees.

Fingerprints are 64-bit SimHashes of word shingles.  Equal fingerprints become
one node.  Nodes within ``radius`` bits agree on at least one of radius + 1
bit blocks, so every node is sent once to each block's shard; a shard that
holds more than ``shard_size`` nodes is split again by the blocks of its
remaining bits, which is exact at every depth and ends because shards hold
distinct fingerprints.  In a shard the nodes form a BK-tree (children keyed by
integer Hamming distance to the parent) and each node's search follows only
the edges within the radius.  Trees stand where their shard was shuffled to
and are not broadcast: the trees of all documents have no size bound.  A shard
emits a star for each group it joins up, never all pairs.

``near_duplicates``, the stage of the pipeline, links by Jaccard similarity:
wider SimHashes in the BK-trees of shards keyed by shingles, and a comparison
of the sets that the trees find.

Nulls: a null text counts as empty; an empty text has fingerprint zero.  Rows
with a null id get a fingerprint and the component of its class, whose number
is null if no member has an id.  Repeated rows are rows of one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, repeat
from math import acos, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm.common import Scratch, fresh, quoted, table
from docquery.llm.components import components
from docquery.llm.kernels import SPACE, digests, expand, joined, lower_ascii, mix, released, rolling_hash, row_of, slices, sound_hash, words

CHUNK = 1 << 15
#: Values of a shard's sets that are multiplied at once.
TERMS = 4096
#: Words of 64 bits in a fingerprint of near_duplicates.
FP_WORDS = 4
#: Pairs of a shard for each row in them, above which their sets are counted by products.
DENSE = 8


def simhash(text: bytes, size: int = 3) -> int:
    """Fingerprint of a text given as UTF-8."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) < size:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(size)), strict=False))
    count, ones = 0, np.zeros(64, dtype=np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    while True:
        part = np.fromiter(islice(hashes, CHUNK), dtype=np.uint64)
        if not len(part):
            break
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        count += len(part)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((simhash(t.as_py() or b"", size) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), f"id {kind}, fp long")


def set_fingerprints(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of FP_WORDS * 64 bits of each set of 32-bit shingle hashes flat[at[i]:at[i + 1]], a row each."""
    n = len(at) - 1
    ones = np.zeros((n, FP_WORDS * 64), dtype=np.int64)
    for lo in range(int(at[0]), int(at[-1]), CHUNK):
        value = flat[lo : min(lo + CHUNK, int(at[-1]))].view(np.uint32).astype(np.uint64)
        first, last = np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, lo + len(value))
        cut = np.clip(at[first : last + 1], lo, lo + len(value)) - lo
        held = np.flatnonzero(np.diff(cut))
        for k in range(FP_WORDS):
            bits = np.unpackbits(mix(value + np.uint64(k + 1 << 32)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[first + held, 64 * k : 64 * k + 64] += np.add.reduceat(bits, cut[held], axis=0, dtype=np.int32)
    return np.packbits(2 * ones > np.diff(at)[:, None], axis=1, bitorder="little").view(np.uint64)


def radius_of(threshold: float) -> int:
    """Bits within which set_fingerprints of sets of that Jaccard similarity lie: 6.6 standard deviations over the mean, 90 of 256 for 0.8.

    Large sets differ in a bit with probability acos(2t / (1 + t)) / pi, small
    ones, of t / (1 - t) values and one more, with up to sqrt(pi / 2) times that.
    """
    bits, p = FP_WORDS * 64, min(0.5, acos(2 * threshold / (1 + threshold)) / sqrt(2 * pi))
    return min(bits, int(bits * p + 6.6 * sqrt(bits * p * (1 - p))))


def bits_apart(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of the fingerprints at a and b; one of several words is a row."""
    d = np.bitwise_count(fp[a] ^ fp[b])
    return d.astype(np.int64) if fp.ndim == 1 else d.sum(1, dtype=np.int64)


def edge_span(fp: np.ndarray) -> int:
    """How many distances there are."""
    return 64 * (1 if fp.ndim == 1 else fp.shape[1]) + 1


def forest(fp: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of all shards, built level by level.

    ``root`` has for each element the index of its tree's root.  Returns the
    sorted edge keys parent * edge_span + distance, and the child at each.
    """
    span = edge_span(fp)
    cur = root.copy()
    left = np.flatnonzero(root != np.arange(len(fp)))
    keys, children = [], []
    while len(left):
        key = cur[left] * span + bits_apart(fp, left, cur[left])
        edge, first, which = np.unique(key, return_index=True, return_inverse=True)
        child = left[first]
        keys.append(edge)
        children.append(child)
        cur[left] = child[which]
        rest = np.ones(len(left), dtype=bool)
        rest[first] = False
        left = left[rest]
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return key[order], child[order]


def search(fp: np.ndarray, root: np.ndarray, trees: tuple[np.ndarray, np.ndarray], radius: int, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) within the radius and in one tree, query > node, a block of queries at a time."""
    keys, children = trees
    span = edge_span(fp)
    sizes = np.bincount(root, minlength=len(fp))[root]
    start = 0
    while start < len(fp):
        stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), at_once)) + start)
        query = np.arange(start, stop)
        node = root[query]
        while len(query):
            d = bits_apart(fp, query, node)
            hit = (d <= radius) & (query > node)
            if hit.any():
                yield query[hit], node[hit]
            lo = np.searchsorted(keys, node * span + np.maximum(d - radius, 0))
            n = np.searchsorted(keys, node * span + np.minimum(d + radius, span - 1), side="right") - lo
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            query, node = np.repeat(query, n), children[at]
        start = stop


def hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs in place: parent[i] leads to the smallest index joined to i."""
    while True:
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        pa_, pb = pa_[apart], pb[apart]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def by_shard(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Cut a partition sorted by ``shard`` into tables of whole shards, of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            shard = t.column("shard").to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))
            if cut:
                yield t.slice(0, cut)
                held, count = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def roots(shard: np.ndarray) -> np.ndarray:
    """For rows sorted by shard, the first row of each row's shard."""
    first = np.ones(len(shard), dtype=bool)
    first[1:] = shard[1:] != shard[:-1]
    at = np.flatnonzero(first)
    return np.repeat(at, np.diff(np.append(at, len(shard))))


def split_shards(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, shard, free) -> one row for each of radius + 1 blocks of the free bits; block values extend the shard's key."""
    blocks = radius + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, shard, free = (np.ascontiguousarray(b.column(i).to_numpy()).view(np.uint64) for i in range(3))
            outs = []
            for mask in np.unique(free):
                own = free == mask
                bits = [i for i in range(64) if int(mask) >> i & 1]
                for k in range(blocks):
                    part = sum(1 << i for i in bits[k * len(bits) // blocks : (k + 1) * len(bits) // blocks])
                    key = mix(mix(shard[own] + np.uint64(k + 1)) ^ mix((fp[own] & np.uint64(part)) + np.uint64(part)))
                    outs.append((fp[own], key, np.full(int(own.sum()), int(mask) & ~part, dtype=np.uint64)))
            if outs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*outs, strict=True)], names=["fp", "shard", "free"])

    return rows.select("fp", "shard", "free").mapInArrow(released(run), "fp long, shard long, free long")


def links(nodes: DataFrame, scratch: Scratch, radius: int = 3, shard_size: int = 4096) -> DataFrame:
    """nodes(fp long), distinct -> star edges (u, v) whose components are those of all links within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_shard(batches):
            fp = np.ascontiguousarray(t.column("fp").to_numpy()).view(np.uint64)
            root = roots(t.column("shard").to_numpy())
            parent = np.arange(len(fp))
            for a, b in search(fp, root, forest(fp, root), radius):
                hook(parent, a, b)
            own = np.flatnonzero(parent != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[parent[own]].view(np.int64))], names=["u", "v"])

    rows = nodes.select("fp", F.lit(0).cast("long").alias("shard"), F.lit(-1).cast("long").alias("free"))
    found = None
    bits = 64
    while True:
        rows = scratch.cut(split_shards(rows, radius))
        bits -= bits // (radius + 1)
        sizes = rows.groupBy("shard").count()
        large = scratch.cut(sizes.where(F.col("count") > shard_size).select("shard"))
        last = bits <= 2 * (radius + 1) or not large.limit(1).count()
        alone = sizes.where("count = 1" if last else f"count = 1 or count > {shard_size}").select("shard")
        small = rows.join(alone, "shard", "left_anti")
        part = small.repartition("shard").sortWithinPartitions("shard").select("fp", "shard").mapInArrow(released(run), "u long, v long")
        found = part if found is None else found.union(part)
        if last:
            return scratch.cut(found.distinct())
        rows = rows.join(large, "shard", "left_semi")


def simhash_components(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, shard_size: int = 4096) -> DataFrame:
    """(id, fp, component): every row's fingerprint and the smallest id reachable over links within ``radius`` bits."""
    since = scratch.count
    fps = scratch.cut(fingerprints(docs, id_col, text_col, size))
    nodes = scratch.cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    label = components(links(nodes, scratch, radius, shard_size), scratch)
    member = scratch.cut(nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    group = member.groupBy("label").agg(F.min("least").alias("component"))
    classes = scratch.cut(member.join(group, "label").select("fp", "component"))
    scratch.prune(since, fps, classes)
    return fps.join(classes, "fp")


def signatures(data: np.ndarray, off: np.ndarray, size: int, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row, over its shingles of ``size`` words (A-Z lower-cased; all words, if fewer): ``keys`` minimum hashes, an XXH3 hash of its words, and the 32-bit shingle hashes with their row boundaries."""
    data = lower_ascii(data)
    s, e, rows = words(data, off, SPACE)
    row, n_rows = row_of(rows, len(s)), len(off) - 1
    h = sound_hash(data, s, e, (41, 42))
    raw, begin, end = joined(data, s, e)
    begin, end = np.append(begin, 0), np.append(end, 0)
    full = np.diff(rows) > 0
    whole = digests(raw, np.where(full, begin[rows[:-1]], 0), np.where(full, end[rows[1:] - 1], 0))[:, 0].view(np.uint64)
    roll = rolling_hash(h, size)
    at = np.flatnonzero(row[: len(roll)] == row[len(h) - len(roll) :])
    short = np.flatnonzero((np.diff(rows) < size) & full)
    value, of = np.concatenate([roll[at], mix(whole[short])]), np.concatenate([row[at], short])
    order = np.argsort(of, kind="stable")
    value, of = value[order], of[order]
    cut = np.searchsorted(of, np.arange(n_rows + 1))
    full = np.flatnonzero(np.diff(cut))
    least = np.zeros((n_rows, keys), dtype=np.uint64)
    if len(full):
        for k in range(keys):
            least[full, k] = np.minimum.reduceat(mix(value ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))), cut[full])
    return least, whole, (value >> np.uint64(32)).astype(np.uint32), cut


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Jaccard similarity of two sorted sets, at least the threshold."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= threshold * (len(a) + len(b) - common)


def alike(flat: np.ndarray, at: np.ndarray, threshold: float, of: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b), a > b, of the sets flat[at[i]:at[i + 1]] whose Jaccard similarity is at least the threshold; with ``of``, those of its pairs.

    Every pair's common values are counted: values of many sets by products of
    0/1 matrices, the others by the pairs of rows that hold one.
    """
    n = len(at) - 1
    if n <= 3 and of is None:
        pairs = [(i, j) for i in range(n) for j in range(i) if similar(flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]], threshold)]
        return np.array([i for i, _ in pairs], dtype=np.int64), np.array([j for _, j in pairs], dtype=np.int64)
    sizes = np.diff(at).astype(np.int64)
    values, row = flat[at[0] : at[-1]], np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    held = np.diff(np.append(first, len(values)))
    term, often = np.repeat(np.arange(len(first)), held), np.repeat(held, held)
    common = np.zeros((n, n), dtype=np.float32)
    many = max(8, n // 8)
    dense = often > many
    if dense.any():
        r, t = row[dense], np.unique(term[dense], return_inverse=True)[1]
        for lo in range(0, int(t.max()) + 1, TERMS):
            a, z = np.searchsorted(t, (lo, lo + TERMS))
            has = np.zeros((n, int(t[z - 1]) - lo + 1), dtype=np.float32)
            has[r[a:z], t[a:z] - lo] = 1
            common += has @ has.T
    few = (often > 1) & ~dense
    r, t = row[few], term[few]
    for k in range(1, many):
        same = t[k:] == t[: len(t) - k]
        if not same.any():
            break
        # rows of a value ascend
        np.add.at(common, (r[k:][same], r[: len(r) - k][same]), 1)
    if of is not None:
        a, b = of
        own = (common[a, b] > 0) & (common[a, b] >= threshold * (sizes[a] + sizes[b] - common[a, b]))
        return a[own], b[own]
    a, b = np.nonzero(np.tril((common > 0) & (common >= threshold * (sizes[:, None] + sizes[None, :] - common)), -1))
    return a, b


def merged(flat: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, at_once: int = 1 << 20) -> np.ndarray:
    """Which of the pairs (a, b) of sets have a Jaccard similarity of the threshold or more; the two sets of each are merged."""
    sizes = np.diff(at).astype(np.int64)
    out = np.zeros(len(a), dtype=bool)
    fit = np.flatnonzero(np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]))
    ends = np.cumsum(sizes[a[fit]] + sizes[b[fit]])
    start = 0
    while start < len(fit):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + at_once)))
        pair = fit[start:stop]
        side = np.concatenate([a[pair], b[pair]])
        key = flat[expand(at[side], sizes[side])].view(np.uint32).astype(np.int64)
        key += np.repeat(np.tile(np.arange(len(pair)) << 32, 2), sizes[side])
        key.sort()
        common = np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=len(pair))
        out[pair] = (common > 0) & (common >= threshold * (sizes[a[pair]] + sizes[b[pair]] - common))
        start = stop
    return out


def verified(flat: np.ndarray, at: np.ndarray, root: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (a, b), each in one shard, whose sets have a Jaccard similarity of the threshold or more.

    Where a shard has many pairs for its rows, these rows' sets are counted at once.
    """
    order = np.argsort(root[a], kind="stable")
    a, b = a[order], b[order]
    begins = np.flatnonzero(np.append(True, root[a][1:] != root[a][:-1])[: len(a)])
    ok = np.zeros(len(a), dtype=bool)
    few = np.ones(len(a), dtype=bool)
    for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(a)], strict=True):
        rows, where = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_inverse=True)
        if hi - lo <= DENSE * len(rows):
            continue
        few[lo:hi] = False
        sizes = np.diff(at).astype(np.int64)[rows]
        x, y = where[: hi - lo], where[hi - lo :]
        p, q = alike(flat[expand(at[rows], sizes)], np.append(0, np.cumsum(sizes)), threshold, (x, y))
        hit = np.zeros((len(rows), len(rows)), dtype=bool)
        hit[p, q] = True
        ok[lo:hi] = hit[x, y]
    few = np.flatnonzero(few)
    ok[few] = merged(flat, at, a[few], b[few], threshold)
    return a[ok], b[ok]


def shard_groups(rows: DataFrame, threshold: float) -> DataFrame:
    """rows(shard, base, node, fp, set), whole shards sorted -> (base, u, v): each node's link to its group's hub, the node with most links in the shard (ties: the first).

    The links of a shard are those its BK-tree finds within the radius and the sets bear out.
    """
    radius = radius_of(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_shard(batches, 4096):
            root, sets, node = roots(t.column("shard").to_numpy()), t.column("set").combine_chunks(), t.column("node").to_numpy()
            fp = np.ascontiguousarray(t.column("fp").combine_chunks().flatten().to_numpy()).view(np.uint64).reshape(len(node), -1)
            at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
            parent, degree = np.arange(len(node)), np.zeros(len(node), dtype=np.int64)
            for a, b in search(fp, root, forest(fp, root), radius, 1 << 18):
                a, b = verified(flat, at, root, a, b, threshold)
                degree += np.bincount(np.concatenate([a, b]), minlength=len(node))
                hook(parent, a, b)
            order = np.lexsort((-degree, parent))
            hub = order[np.searchsorted(parent[order], parent)]
            own = np.flatnonzero((hub != np.arange(len(node))) & (degree > 0))
            yield pa.RecordBatch.from_arrays([t.column("base").combine_chunks().take(pa.array(own)), pa.array(node[own]), pa.array(node[hub[own]])], names=["base", "u", "v"])

    return rows.select("shard", "base", "node", "fp", "set").mapInArrow(released(run), "base long, u long, v long")


def block_pairs(rows: DataFrame, block: int, widest: int) -> DataFrame:
    """rows(base, node, class, count, main) -> (shard, base, node), a shard for each pair of blocks in which nodes of different labels can be alike.

    ``class`` is the class of a node's set size: nodes more than one class
    apart are not alike.  ``main`` marks the nodes of the shard's largest
    label, which need not meet one another.  ``count`` has the nodes of each
    (class, main) of the shard; blocks hold about ``block`` nodes of one of
    these.  A pair of blocks is emitted only if the shard has both.
    """
    n_blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    at = F.pmod(F.xxhash64("node", F.lit(1)), n_blocks(F.try_element_at("count", F.struct("class", "main")))).cast("int")
    own = rows.withColumn("own", F.struct("class", "main", at.alias("at")))

    def others(step: int, main: bool) -> Column:
        n = F.try_element_at("count", F.struct((F.col("class") + step).alias("class"), F.lit(main).alias("main")))
        every = F.transform(F.sequence(F.lit(0), n_blocks(n) - 1), lambda i: F.struct((F.col("class") + step).alias("class"), F.lit(main).alias("main"), i.alias("at")))
        return F.when(n.isNotNull(), every).otherwise(F.filter(every, lambda x: F.lit(False)))

    meets = F.concat(*[F.when(F.lit(main) & F.col("main"), F.filter(F.array("own"), lambda x: F.lit(False))).otherwise(others(step, main)) for step in range(-widest, widest + 1) for main in (False, True)])
    return own.select("base", "node", F.explode(F.transform(meets, lambda b: F.xxhash64("base", F.least(b, "own"), F.greatest(b, "own")))).alias("shard"))


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, keys: int = 6, shard_size: int = 1024, kept_col: str = "_kept") -> DataFrame:
    """docs with ``kept_col``: true for one row of each group of texts linked by Jaccard similarity ``threshold`` of ``size``-word shingles, the first by id.

    Fingerprints are SimHashes of 256 bits over each text's set of shingles;
    in every shard they form a BK-tree, whose search within ``radius_of`` the
    threshold gives the pairs, and the sets of these are compared.  Two sets
    of similarity 0.8 differ in a bit with probability 0.1875 at most (4
    shingles, and one more) and 0.15 if they are large, so that fewer than one
    of 10 ** 9 such pairs is beyond its 90 bits.

    Texts so far apart agree on no block of bits, so shards are keyed by
    minimum shingle hashes: two such texts share one of ``keys`` with
    probability 1 - (1 - threshold) ** keys, 0.99994 by default; no other step
    loses a link.  Texts of equal words are one node from the start.

    First each node is compared in the largest of its shards only, in blocks
    of about ``shard_size`` nodes; what a large shard's blocks leave apart is
    dealt to new blocks, each with the node that found most links, so that a
    group held together by one original is joined here.  Then the shards that
    still hold nodes of different groups are settled: small ones by comparing
    all their nodes, large ones by pairs of blocks.  Blocks are of one class
    of set size, and only adjacent classes can be alike; nodes of a shard's
    largest group need not meet one another.  So a group of copies costs
    nothing more however large it is; a large shard of texts of one size that
    are not alike costs the square of its size.

    Nulls: a null text counts as empty, empty texts are a group; null ids come
    first.  Of rows alike in id and text one is kept.  Ties of an id are
    broken by a hash of the text.  The columns may have any names.
    """
    since = scratch.count
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    i, h, i2, h2, first_, row_ = fresh(docs, "i", "h", "i2", "h2", "first", "row")
    given = docs.select("*", quoted(id_col).alias(i), F.xxhash64(text).alias(h))
    base = docs.select(quoted(id_col).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, off in slices(b, "text"):
                least, whole, _, cut = signatures(data, off, size, keys)
                has = np.diff(cut) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * keys)]).astype(np.int32)), pa.array(least[has].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(whole.view(np.int64)), lists], names=["_id", "_h", "node", "keys"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, off in slices(b, "text"):
                _, _, value, cut = signatures(data, off, size, 0)
                sets = [np.unique(value[a:z]).view(np.int32) for a, z in zip(cut[:-1], cut[1:], strict=True)]
                flat, at = np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets]))
                fps = set_fingerprints(flat, at).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(x.astype(np.int32)), pa.array(y)) for x, y in ((np.arange(len(sets) + 1) * FP_WORDS, fps.ravel()), (at, flat))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["node", "fp", "set"])

    def none(df: DataFrame) -> bool:
        return not df.limit(1).count()

    signed = base.mapInArrow(released(sign), f"_id {kind}, _h long, node long, keys array<long>")
    nodes = scratch.cut(signed.groupBy("node").agg(F.min(F.struct("_id", "_h")).alias("first"), F.first("keys").alias("keys")))

    # every node's keys stay in these joins, alone or not: a shard's size does not change their rows
    flat = scratch.cut(nodes.select("node", F.posexplode("keys").alias("k", "key")).select("node", F.xxhash64("k", "key").alias("base")))
    shared = scratch.cut(flat.groupBy("base").agg(F.count("*").alias("n")).where("n > 1"))
    top = flat.join(shared.hint("shuffle_hash"), "base", "left").groupBy("node").agg(F.max(F.struct("n", "base")).alias("top")).where("top.n is not null")
    top = scratch.cut(top.select("node", "top.n", "top.base"))
    wanted = top.join(nodes, "node").select("node", F.col("first._id").alias("i"), F.col("first._h").alias("j"))
    sets = base.join(wanted, F.col("_id").eqNullSafe(F.col("i")) & (F.col("_h") == F.col("j"))).select("node", "text").mapInArrow(released(gather), "node long, fp array<long>, set array<int>")
    members = scratch.cut(sets.dropDuplicates(["node"]))

    def solve(rows: DataFrame) -> DataFrame:
        """rows(shard, base, node) -> (base, u, v)"""
        return scratch.cut(shard_groups(rows.join(members, "node").repartition("shard").sortWithinPartitions("shard", "node"), threshold))

    def dealt(seed: int) -> Column:
        return F.xxhash64("base", F.lit(seed), F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.col("n") / shard_size)))

    edges = found = solve(top.select(F.when(F.col("n") <= shard_size, F.col("base")).otherwise(dealt(2)).alias("shard"), "base", "node"))
    large = top.where(F.col("n") > shard_size)
    if not none(large):
        size_of = found.join(large.select("base").distinct(), "base", "left_semi").groupBy("base", "v").count()
        pivots = scratch.cut(size_of.groupBy("base").agg(F.max(F.struct("count", "v")).alias("top")).select("base", F.col("top.v").alias("pivot")))
        near = found.select(F.col("u").alias("node"), "base", "v")
        apart = large.join(pivots.hint("shuffle_hash"), "base").join(near, ["node", "base"], "left").where("node <> pivot and (v is null or v <> pivot)")
        blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / shard_size) - 1), lambda b: F.xxhash64("base", F.lit(3), b))
        every = large.groupBy("base").agg(F.max("n").alias("n")).join(pivots, "base").select(F.explode(blocks).alias("shard"), "base", F.col("pivot").alias("node"))
        found = solve(apart.select(dealt(3).alias("shard"), "base", "node").union(every))
        edges = edges.union(found)

    label = scratch.cut(members.select("node").join(components(edges.select("u", "v").distinct(), scratch), "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    # a small shard that was the largest of all its nodes is settled
    settled = top.where(F.col("n") <= shard_size).groupBy("base", "n").count().where("count = n").select("base", F.lit(True).alias("settled"))
    marked = scratch.cut(flat.join(label, "node", "left").join(settled.hint("shuffle_hash"), "base", "left").where("label is not null and settled is null").select("base", "node", "label"))
    tally = marked.groupBy("base", "label").count()
    open_ = scratch.cut(tally.groupBy("base").agg(F.sum("count").alias("n"), F.max(F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("base", "n", "main.label"))
    rest = scratch.cut(marked.join(open_.withColumnRenamed("label", "main").hint("shuffle_hash"), "base", "left").where("n is not null").select("base", "node", "n", (F.col("label") == F.col("main")).alias("main")))
    if not none(rest):
        found = solve(rest.where(F.col("n") <= shard_size).select(F.col("base").alias("shard"), "base", "node"))
        large = rest.where(F.col("n") > shard_size)
        if not none(large):
            # a little wider than the threshold, so that rounding parts no pair by two classes
            sized = members.select("node", F.floor(F.log(F.size("set")) / (1.001 * -log(threshold))).cast("int").alias("class"))
            large = scratch.cut(large.join(sized, "node").select("base", "node", "class", "main"))
            per = large.groupBy("base", "class", "main").count()
            counts = per.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("class", "main").alias("key"), "count"))).alias("count"))
            found = found.union(solve(block_pairs(large.join(counts.hint("shuffle_hash"), "base"), shard_size // 2, 1)))
        label = components(label.select(F.col("node").alias("u"), F.col("label").alias("v")).union(found.select("u", "v")).distinct(), scratch)
    group = nodes.join(label, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first"))
    kept = scratch.cut(group.select(F.col("first._id").alias(i2), F.col("first._h").alias(h2), F.lit(True).alias(first_)))
    scratch.prune(since, kept)
    out = given.join(kept.hint("shuffle_hash"), F.col(i).eqNullSafe(F.col(i2)) & (F.col(h) == F.col(h2)), "left")
    # rows alike in id and text: one of them
    out = out.withColumn(row_, F.row_number().over(Window.partitionBy(i, h).orderBy(F.lit(0))))
    return out.select(*map(quoted, docs.columns), (F.coalesce(F.col(first_), F.lit(False)) & (F.col(row_) == 1)).alias(kept_col))


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_simhash_bktree": op5_simhash_bktree}
SQL: dict[str, str] = {}
