"""Operator 2: language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of each word (letters only, A-Z lower-cased; of a
longer one pieces of about SEGMENT bytes that end with a character), forwards
and backwards, and labels every position with a distribution over the languages; a document's log
probabilities are pooled over all positions of all its words.  As the
recurrence begins anew at each word, equal words have equal labels, so a task
runs each distinct word once and sums by word counts.  The weights are trained
with numpy by backpropagation through time on the driver.

Training rows: at most ``per_language`` documents of each language and
``words_per_document`` of the words of each, chosen by hash; rows that
``train_on`` rules out and rows without a language are never read for it.
Prediction covers every whole text and sees the text only.

Nulls: a null text or one without a letter is "und" with score 0; a null id is
kept.  Ties go to the language that sorts first.  Repeated rows each get their
row.  With no training rows all texts are "und".
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm.common import table
from docquery.llm.kernels import byte_table, lower_ascii, prefix_hash, range_hash, released, row_of, separators, slices, words

#: All ASCII but lower-case letters.
NO_LETTER = separators([(0x00, 0x60), (0x7B, 0x7F)])
SEGMENT = 24
HIDDEN = 16
CACHE = 1_500_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """GRU cells in both directions with a softmax at each position."""

    def __init__(self, n_languages: int, hidden: int = HIDDEN, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        self.hidden = hidden
        self.w = {"x0": init(257, 3 * hidden), "x1": init(257, 3 * hidden), "u0": init(hidden, 3 * hidden), "u1": init(hidden, 3 * hidden), "v": init(2 * hidden, n_languages), "c": np.zeros(n_languages, dtype=np.float32)}

    def _run(self, text: np.ndarray, mask: np.ndarray, d: int) -> list[tuple]:
        """States of one direction; text (rows, steps) of byte codes, 256 where there is none."""
        n, steps = text.shape
        hidden, x, u = self.hidden, self.w[f"x{d}"], self.w[f"u{d}"]
        h = np.zeros((n, hidden), dtype=np.float32)
        out = [()] * steps
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            gx, gh = x[text[:, t]], h @ u
            zr = _sigmoid(gx[:, : 2 * hidden] + gh[:, : 2 * hidden])
            z, r = zr[:, :hidden], zr[:, hidden:]
            q = gh[:, 2 * hidden :]
            new = np.tanh(gx[:, 2 * hidden :] + r * q)
            m = mask[:, t : t + 1]
            before = h
            h = np.where(m, (1 - z) * new + z * h, h)
            out[t] = (before, z, r, q, new, h)
        return out

    def log_probabilities(self, text: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sum over each row's positions of the log probabilities."""
        a, b = self._run(text, mask, 0), self._run(text, mask, 1)
        total = np.zeros((len(text), len(self.w["c"])), dtype=np.float32)
        for t in range(text.shape[1]):
            o = np.concatenate([a[t][5], b[t][5]], axis=1) @ self.w["v"] + self.w["c"]
            o -= o.max(1, keepdims=True)
            o -= np.log(np.exp(o).sum(1, keepdims=True))
            total += np.where(mask[:, t : t + 1], o, 0)
        return total

    def gradients(self, text: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients by backpropagation through time."""
        hidden, n = self.hidden, len(text)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        runs = [self._run(text, mask, d) for d in (0, 1)]
        count, loss = max(int(mask.sum()), 1), 0.0
        out_grad: list[list[np.ndarray]] = [[], []]
        for t in range(text.shape[1]):
            s = np.concatenate([runs[0][t][5], runs[1][t][5]], axis=1)
            o = s @ self.w["v"] + self.w["c"]
            p = np.exp(o - o.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            m = mask[:, t]
            loss -= float(np.log(p[np.arange(n), label] + 1e-9)[m].sum())
            p[np.arange(n), label] -= 1
            p *= m[:, None] / count
            g["v"] += s.T @ p
            g["c"] += p.sum(0)
            back = p @ self.w["v"].T
            out_grad[0].append(back[:, :hidden])
            out_grad[1].append(back[:, hidden:])
        for d in (0, 1):
            carry = np.zeros((n, hidden), dtype=np.float32)
            for t in range(text.shape[1] - 1, -1, -1) if d == 0 else range(text.shape[1]):
                before, z, r, q, new, _ = runs[d][t]
                m = mask[:, t : t + 1]
                total = carry + out_grad[d][t]
                at = np.where(m, total, 0)
                pre_new = at * (1 - z) * (1 - new * new)
                pre_z = at * (before - new) * z * (1 - z)
                pre_r = pre_new * q * r * (1 - r)
                gx = np.concatenate([pre_z, pre_r, pre_new], axis=1)
                gh = np.concatenate([pre_z, pre_r, pre_new * r], axis=1)
                np.add.at(g[f"x{d}"], text[:, t], gx)
                g[f"u{d}"] += before.T @ gh
                carry = np.where(m, at * z + gh @ self.w[f"u{d}"].T, total)
        return loss / count, g


def pack(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes and mask of words, padded to the longest."""
    width = int((e - s).max())
    at = s[:, None] + np.arange(width)
    mask = at < e[:, None]
    return np.where(mask, data[np.minimum(at, len(data) - 1)], 256).astype(np.int64), mask


def train(samples: dict[str, list[bytes]], steps: int = 900, batch: int = 384, rate: float = 0.01, seed: int = 5) -> tuple[list[str], Network]:
    """Adam on word batches drawn evenly from the languages."""
    langs = sorted(k for k, v in samples.items() if v)
    net = Network(len(langs))
    data = np.frombuffer(b"".join(w for x in langs for w in samples[x]) or b" ", dtype=np.uint8)
    size = np.array([len(w) for x in langs for w in samples[x]])
    end = np.cumsum(size)
    first = np.cumsum([0, *(len(samples[x]) for x in langs)])
    rng = np.random.default_rng(seed)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for i in range(1, steps + 1):
        label = rng.integers(0, len(langs), batch)
        pick = first[label] + (rng.random(batch) * (first[label + 1] - first[label])).astype(np.int64)
        text, mask = pack(data, end[pick] - size[pick], end[pick])
        _, g = net.gradients(text, mask, label)
        lr = rate * min(1.0, 3 * (1 - i / (steps + 1)))
        for k, v in g.items():
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            net.w[k] -= (lr * (m1[k] / (1 - 0.9**i)) / (np.sqrt(m2[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
    return langs, net


class Labels:
    """Sums of log probabilities of distinct words, by word hash."""

    def __init__(self, net: Network, n_languages: int) -> None:
        self.net = net
        self.keys = np.zeros(0, dtype=np.uint64)
        self.sums = np.zeros((0, n_languages), dtype=np.float32)

    def of(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), dtype=bool)
        out = np.zeros((len(keys), self.sums.shape[1]), dtype=np.float32)
        out[known] = self.sums[at[known]]
        new = np.flatnonzero(~known)
        size = (e - s)[first[new]]
        new = new[np.argsort(size, kind="stable")]
        for i in range(0, len(new), 4096):
            own = new[i : i + 4096]
            text, mask = pack(data, s[first[own]], e[first[own]])
            out[own] = self.net.log_probabilities(text, mask)
        if len(self.keys) + len(new) > CACHE:
            self.keys, self.sums = keys, out
        elif len(new):
            keys_all = np.concatenate([self.keys, keys[new]])
            order = np.argsort(keys_all)
            self.keys, self.sums = keys_all[order], np.concatenate([self.sums, out[new]])[order]
        return out[which]


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words of lower-cased texts, long words cut into pieces of about SEGMENT bytes between characters."""
    s, e, rows = words(data, off, NO_LETTER)
    row = row_of(rows, len(s))
    pieces = (e - s + SEGMENT - 1) // SEGMENT
    if len(s) and pieces.max() > 1:
        of = np.repeat(np.arange(len(s)), pieces)
        k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        s2 = s[of] + k * SEGMENT
        for _ in range(3):  # a character's bytes after the first are 10xxxxxx
            s2 = np.where((k > 0) & (data[s2] & 0xC0 == 0x80), s2 - 1, s2)
        last = np.append(of[1:] != of[:-1], True)
        return s2, np.where(last, e[of], np.append(s2[1:], 0)), row[of]
    return s, e, row


def training_words(docs: DataFrame, per_language: int, words_per_document: int) -> dict[str, list[bytes]]:
    """docs(lang, text, u): a bounded number of words of a bounded number of documents for each language."""
    # rows whose hash is below a share of their language that holds about twice the bound, so that the ranking reads no more as the corpus grows
    share = {r.lang: min(1.0, (2 * per_language + 50) / r["count"]) for r in docs.groupBy("lang").count().collect()}
    if not share:
        return {}
    below = F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv])
    some = docs.where(F.pmod("u", F.lit(1 << 30)) < F.element_at(below, F.col("lang")) * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    chosen = some.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, off in slices(b, "text"):
                data = lower_ascii(data)
                s, e, row = segments(data, off)
                order = np.lexsort((np.arange(len(s)) * np.int64(2654435761) % 1000003, row))  # spread over the text
                at = np.searchsorted(row[order], np.arange(part.num_rows + 1))
                own = np.concatenate([order[a : min(z, a + words_per_document)] for a, z in zip(at[:-1], at[1:], strict=True)] or [order])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[own])), pa.array([data[x:y].tobytes() for x, y in zip(s[own].tolist(), e[own].tolist(), strict=True)], pa.binary())], names=["lang", "word"])

    out: dict[str, list[bytes]] = {}
    for r in chosen.mapInArrow(released(pick), "lang string, word binary").toLocalIterator():
        out.setdefault(r.lang, []).append(bytes(r.word))
    return {k: sorted(v) for k, v in out.items()}


def learn(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, words_per_document: int = 200, steps: int = 900) -> tuple[list[str], Network]:
    """The languages of the rows where ``train_on`` holds, in order, and the network trained on these rows."""
    text = F.col(text_col).cast("string")
    rows = docs.where(train_on & F.col(lang_col).isNotNull() & text.isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")).alias("u"))
    samples = training_words(rows, per_language, words_per_document)
    return train(samples, steps) if samples else ([], Network(1))


def languages(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, words_per_document: int = 200, steps: int = 900) -> DataFrame:
    """(id, lang_pred, score, n_positions) for every row; trains on the rows where ``train_on`` holds."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    langs, net = learn(docs, train_on, id_col, text_col, lang_col, per_language, words_per_document, steps)
    shared = spark.sparkContext.broadcast((langs, net))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, net = shared.value
        cache, letter = Labels(net, max(len(langs), 1)), regex.compile(r"\p{L}")
        names = np.array([*langs, "und"], dtype=object)
        for b in batches:
            for part, raw, off in slices(b, "text", 1 << 20):
                data = lower_ascii(raw)
                n = part.num_rows
                s, e, row = segments(data, off)
                h = range_hash(prefix_hash(byte_table(9)[data]), s, e)
                sums = cache.of(data, s, e, h) if len(s) else np.zeros((0, max(len(langs), 1)), dtype=np.float32)
                total = np.stack([np.bincount(row, weights=sums[:, k], minlength=n) for k in range(sums.shape[1])], axis=1)
                positions = np.bincount(row, weights=e - s, minlength=n)
                mean = total / np.maximum(positions, 1)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                score = p.max(1)
                ascii_letter = np.concatenate([[0], np.cumsum((data >= 0x61) & (data <= 0x7A))])
                lettered = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
                for i in np.flatnonzero(~lettered & (positions > 0)):
                    lettered[i] = bool(letter.search(raw[off[i] : off[i + 1]].tobytes().decode()))
                und = ~lettered if langs else np.ones(n, dtype=bool)
                best[und], score[und] = len(langs), 0.0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(positions.astype(np.int64))], names=["id", "lang_pred", "score", "n_positions"])

    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(released(run), f"id {kind}, lang_pred string, score double, n_positions long")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages(table(spark, sf_dir, "documents"), ~held_out())
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "n_positions")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
