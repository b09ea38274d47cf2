"""Operator 4: a quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or abstain on a text's
statistics.  Expectation-maximisation over the counts of all vote patterns
(three to the number of labellers at most, whatever the corpus) estimates for
both classes how often each labeller votes what, and with that the posterior
of each pattern.  The posteriors are the labels that train a linear scorer
over hashed n-grams of byte classes and word-repeat marks; it gives every text
its score, and texts below ``threshold`` are rejected.

The scorer is fitted on about ``sample`` rows, chosen by hash; all else covers
all rows.  No quality label is read.

Nulls: a null or empty text, or one without words, scores 0 and is rejected; a
null id is kept.  Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquery.llm.common import bound_batches, fresh, quoted, table
from docquery.llm.kernels import SPACE, byte_table, prefix_hash, range_hash, released, row_of, slices, words

#: Labellers: statistic, bad at or beyond, good at or before (compared downwards where bad < good).
LABELLERS: tuple[tuple[str, float, float], ...] = (
    ("marked", 0.10, 0.02),
    ("shouted", 0.25, 0.10),
    ("bare", 0.12, 0.05),
    ("repeated", 0.10, 0.03),
    ("variety", 0.20, 0.30),
    ("letters", 0.60, 0.90),
    ("symbols", 0.12, 0.06),
)
MIN_WORDS_VARIETY = 40
#: Added to the sizes that shares are taken of, so that a few words are no evidence.
SMALL_WORDS, SMALL_BYTES = 5, 80
DIM = 1 << 13
NGRAM = 4
SAMPLE = 8_000
#: Texts of a word or two stay undecided at 0.3 to 0.5; they are not rejected.
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 1 if c.islower() or b >= 0x80 else 2 if c.isupper() else 3 if c.isdigit() else 4 if b in (9, 11, 12, 13, 32) else 5 if b == 10 else 6 if c in ".,;:'\"()-" else 7 if b < 32 else 8 + b % 23
    return out


CLASS = _classes()
LETTER, UPPER = np.isin(CLASS, (1, 2)), CLASS == 2
SYMBOL = CLASS >= 7
PLAIN = np.isin(CLASS, (1, 2, 3))


def statistics(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, tuple]:
    """Per row: each labeller's statistic; the number of words; the words with their hashes."""
    s, e, rows = words(data, off, SPACE)
    row, n_rows = row_of(rows, len(s)), len(off) - 1
    n = np.diff(rows)
    per = lambda x: np.bincount(row[x], minlength=n_rows) / (n + SMALL_WORDS)
    total = lambda m: np.concatenate([[0], np.cumsum(m)])
    upper, letter, plain, symbol = total(UPPER[data]), total(LETTER[data]), total(PLAIN[data]), total(SYMBOL[data])
    span = lambda t: t[e] - t[s]
    h = range_hash(prefix_hash(byte_table(5)[data]), s, e)
    again = np.zeros(len(s), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    tail = (e - s >= 2) & SYMBOL[data[e - 1]] & (data[e - 1] == data[np.maximum(e - 2, 0)]) if len(s) else np.zeros(0, dtype=bool)
    key = np.lexsort((h, row))
    new = np.ones(len(s), dtype=bool)
    new[1:] = (h[key][1:] != h[key][:-1]) | (row[key][1:] != row[key][:-1])
    distinct = np.bincount(row[key][new], minlength=n_rows)
    inside = np.bincount(row, weights=e - s, minlength=n_rows)
    return (
        {
            "marked": per(tail),
            "shouted": per((span(letter) >= 2) & (span(upper) == span(letter))),
            "bare": per(span(plain) == 0),
            "repeated": per(again),
            "variety": np.where(n >= MIN_WORDS_VARIETY, distinct / np.maximum(n, 1) * np.maximum(1, np.log2(np.maximum(n, 1) / 500)), np.nan),
            "letters": 1 - (inside - np.bincount(row, weights=span(letter), minlength=n_rows)) / (inside + SMALL_BYTES),
            "symbols": np.bincount(row, weights=span(symbol), minlength=n_rows) / (inside + SMALL_BYTES),
        },
        n,
        (s, row, again),
    )


def votes(stats: dict[str, np.ndarray], n: np.ndarray) -> np.ndarray:
    """Pattern of each row: base-3 digits by labeller, 0 bad, 1 good, 2 abstain; -1 for a text without words."""
    out = np.zeros(len(n), dtype=np.int64)
    for name, bad, good in LABELLERS:
        x = stats[name]
        with np.errstate(invalid="ignore"):
            low, high = (x >= bad, x <= good) if bad > good else (x <= bad, x >= good)
        out = out * 3 + np.where(low, 0, np.where(high, 1, 2))
    return np.where(n == 0, -1, out)


def digits(pattern: np.ndarray) -> np.ndarray:
    return np.stack([pattern // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))], axis=1)


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM.  Posterior of good for each pattern, and each labeller's table (class, vote), class 0 bad and 1 good.

    Bad texts are of several kinds that different labellers see, so the bad
    class is a mixture of as many parts as there are labellers, each begun
    from the patterns in which its labeller votes bad.
    """
    v = digits(patterns)
    m = v.shape[1]
    bad = v == 0
    r = np.full((len(v), m + 1), 0.03 / m)
    r[:, m] = np.where(bad.any(1), 0.1, 0.97)
    r[:, :m] = np.where(bad.any(1)[:, None], 0.9 * bad / np.maximum(bad.sum(1), 1)[:, None], r[:, :m])
    for _ in range(rounds):
        weight = r * counts[:, None]
        p = np.full((m + 1, m, 3), 0.3)
        for c in range(3):
            p[:, :, c] += weight.T @ (v == c)
        p /= p.sum(2, keepdims=True)
        prior = (weight.sum(0) + 0.1) / (weight.sum() + 0.1 * (m + 1))
        log = np.log(prior) + np.log(p)[:, np.arange(m), v].sum(2).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - r).max() if len(r) else 0.0
        r = new
        if moved < 1e-6:
            break
    share = prior[:m] / prior[:m].sum()
    return r[:, m], np.stack([(share[:, None, None] * p[:m]).sum(0), p[m]])


def features(data: np.ndarray, off: np.ndarray, extra: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features as (row, index, value): shares of class n-grams and of word-repeat marks."""
    n_rows = len(off) - 1
    s, row, again = extra
    c = CLASS[data]
    parts = []
    if len(data) >= NGRAM:
        code = c[: len(c) - NGRAM + 1].copy()
        for k in range(1, NGRAM):
            code = code * 32 + c[k : len(c) - NGRAM + 1 + k]
        of = np.repeat(np.arange(n_rows), np.diff(off))
        inside = of[: len(code)] == of[NGRAM - 1 :]
        slot = (code * 2654435761 >> 7) % (DIM - 2)
        parts.append(of[: len(code)][inside] * DIM + slot[inside])
    key = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    at, n = np.unique(key, return_counts=True)
    r = at // DIM
    size = np.bincount(r, weights=n, minlength=n_rows) + SMALL_BYTES
    value = np.sqrt(n / size[r])
    words_in = np.bincount(row, minlength=n_rows) + SMALL_WORDS
    rep = np.sqrt(np.bincount(row[again], minlength=n_rows) / words_in)
    own = np.flatnonzero(rep)
    return np.concatenate([r, own]), np.concatenate([at % DIM, np.full(len(own), DIM - 1)]), np.concatenate([value, rep[own]])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 100_000, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression by AdaGrad on soft labels; the last entry is the intercept."""
    w, g2 = np.zeros(DIM + 1), np.full(DIM + 1, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(max(1, steps // len(rows))):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            z = w[at] @ x + w[DIM]
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            step = g * x + decay * w[at]
            g2[at] += step * step
            g2[DIM] += g * g
            w[at] -= rate * step / np.sqrt(g2[at])
            w[DIM] -= rate * g / np.sqrt(g2[DIM])
    return w


def _votes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, off in slices(b, "text"):
                stats, n, _x = statistics(data, off)
                yield pa.RecordBatch.from_arrays([pa.array(votes(stats, n))], names=["pattern"])

    return docs.select("text").mapInArrow(released(run), "pattern long")


def fit(base: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base(id, text) -> the patterns seen, the posterior of good for each, and the scorer's weights."""
    spark = base.sparkSession
    counted = sorted((r.pattern, r["count"]) for r in _votes(base).groupBy("pattern").count().collect())
    seen = [x for x in counted if x[0] >= 0]
    patterns, counts = np.array([x[0] for x in seen], dtype=np.int64), np.array([x[1] for x in seen], dtype=float)
    good = fit_votes(patterns, counts)[0] if seen else np.zeros(0)
    posterior = spark.sparkContext.broadcast((patterns, good))
    share = min(1.0, sample / max(counts.sum(), 1))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = posterior.value
        for b in batches:
            for _, data, off in slices(b, "text"):
                stats, n, extra = statistics(data, off)
                p = votes(stats, n)
                r, at, x = features(data, off, extra)
                order = np.argsort(r, kind="stable")
                cut = np.searchsorted(r[order], np.arange(len(n) + 1))
                lists = [pa.LargeListArray.from_arrays(pa.array(cut), pa.array(v[order])) for v in (at.astype(np.int32), x.astype(np.float32))]
                label = np.where(p >= 0, value[np.minimum(np.searchsorted(known, p), len(known) - 1)] if len(known) else 0.0, 0.0)
                out = pa.RecordBatch.from_arrays([pa.array(label), lists[0].cast(pa.list_(pa.int32())), lists[1].cast(pa.list_(pa.float32()))], names=["label", "at", "x"])
                yield out.filter(pa.array(p >= 0))

    u = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    rows = base.where(u < share).select("text").mapInArrow(released(gather), "label double, at array<int>, x array<float>").toArrow()
    at, x = rows.column("at").combine_chunks(), rows.column("x").combine_chunks()
    pairs = [(np.array(a.values), np.array(v.values, dtype=float)) for a, v in zip(at, x, strict=True)]
    w = train(pairs, rows.column("label").to_numpy()) if pairs else np.zeros(DIM + 1)
    return patterns, good, w


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD, keep_columns: bool = False, names: tuple[str, str, str, str] = ("score", "posterior", "pattern", "keep")) -> DataFrame:
    """(id, score, posterior, pattern, keep) for every row, or the rows themselves with these columns; ``names`` renames them, and an input column that is named so is replaced."""
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    patterns, good, w = fit(base, sample)
    posterior, weights = spark.sparkContext.broadcast((patterns, good)), spark.sparkContext.broadcast(w)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = posterior.value
        w = weights.value
        for b in batches:
            for part, data, off in slices(b, text_):
                stats, n, extra = statistics(data, off)
                p = votes(stats, n)
                r, at, x = features(data, off, extra)
                z = np.bincount(r, weights=w[at] * x, minlength=len(n)) + w[DIM]
                s = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                label = np.where(p >= 0, value[np.minimum(np.searchsorted(known, p), len(known) - 1)] if len(known) else 0.0, 0.0)
                cols = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array(label), pa.array(p), pa.array(s >= threshold)], names=[*part.schema.names[:-1], *names])

    (text_,) = fresh(docs, "whole")
    carried = [(quoted(f.name), f) for f in docs.schema.fields if f.name not in names] if keep_columns else [(quoted(id_col).alias("id"), T.StructField("id", docs.schema[id_col].dataType))]
    given = docs.select(*[c for c, _ in carried], quoted(text_col).cast("string").alias(text_))
    made = [T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.DoubleType(), T.LongType(), T.BooleanType()), strict=True)]
    return given.mapInArrow(released(score), T.StructType([*[f for _, f in carried], *made]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
