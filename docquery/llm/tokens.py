"""Operator 7: token counts by pre-token.

Token counts of byte-level BPE add up over pre-tokens, so no ids are made: the
distinct pre-tokens of the corpus are gathered with their frequencies, the
pieces of each are counted once, and each document's pre-token frequencies are
joined to these counts and summed.

A hot key cannot arise: the most frequent pre-tokens, ``frequent`` at most, are
broadcast and summed where the document is read; one of more than
``KEY_BYTES`` bytes is known by a 128-bit digest, so the broadcast is bounded
by the product.  Only the rest, the long tail, is shuffled to the table of
counts and back to its document.

Special strings in a text are handled as the library does by default: an
occurrence is one token and cuts the text.  Nulls: a null text counts as
empty, a null id is kept.  Repeated rows, and rows of one id (ties), each get
their row.  An empty table gives an empty one; a long text is split whole, by
one task.  Columns other than id and text are not read.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquery.llm.common import Scratch, table
from docquery.llm.kernels import released

#: The pattern that byte-level BPE vocabularies of this kind are defined with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer pre-tokens are joined by their digest.
KEY_BYTES = 64
#: Pre-tokens, and characters of text, that a task gathers before it passes their counts on.
HELD, HELD_CHARS = 400_000, 1 << 28


def key_of(pre_token: str) -> str:
    """A pre-token, or its digest after a control character, which never shares a pre-token with letters or digits."""
    return pre_token if len(pre_token) * 4 <= KEY_BYTES or len(raw := pre_token.encode()) <= KEY_BYTES else "\x01" + xxhash.xxh3_128_hexdigest(raw)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The text of a tokenizer file of the installed vocabularies."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


class PreTokens:
    """Splits texts as the tokenizer does; ``spec`` is the tokenizer's JSON."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.find = regex.compile(PATTERN).findall
        special = [x["content"] for x in json.loads(spec)["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.alike = set(map(chr, range(128)))
        self.odd: set[str] = set()

    def _check(self, char: str) -> None:
        """Characters that the two libraries' Unicode versions class differently are split by the tokenizer's own code."""
        probe = f"a{char}1{char}!{char}b {char}"
        (self.alike if [probe[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)] == self.find(probe) else self.odd).add(char)

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and the number of special strings in it."""
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            out: list[str] = []
            for p in parts:
                out += self.split_plain(p)
            return out, len(parts) - 1
        return self.split_plain(text), 0

    def split_plain(self, text: str) -> list[str]:
        if not text.isascii():
            for c in set(text) - self.alike - self.odd:
                self._check(c)
            if self.odd and not self.odd.isdisjoint(text):
                return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch(pre_tokens, add_special_tokens=False)]


def pre_token_table(docs: DataFrame, spec) -> DataFrame:
    """(pre_token, freq, n): every distinct pre-token of the corpus, by its key, counted once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, held = PreTokens(spec.value), Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["pre_token", "freq"])
        chars = 0
        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                chars += len(text)
                held.update(tool.split(text)[0])
                if len(held) > HELD or chars > HELD_CHARS:
                    yield flush()
                    held.clear()
                    chars = 0
        yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = PreTokens(spec.value)
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(key_of, texts), pa.string()), b.column(1), pa.array(tool.pieces(texts), pa.int32())], names=["pre_token", "freq", "n"])

    found = docs.select("text").mapInArrow(released(gather), "pre_token string, freq long").groupBy("pre_token").agg(F.sum("freq").alias("freq"))
    return found.mapInArrow(released(count), "pre_token string, freq long, n int")


def token_counts(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", spec: str | None = None, frequent: int = 1 << 18) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec or vocabulary())
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = scratch.cut(pre_token_table(docs, shared))

    # The frequencies from which at most ``frequent`` pre-tokens are left, from a histogram of powers of two.
    level = F.floor(F.log2("freq") * 4).cast("int")
    total, least = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if total + r["count"] > frequent:
            break
        total, least = total + r["count"], r.level
    top = {} if least is None else {r.pre_token: r.n for r in counts.where(level >= least).select("pre_token", "n").toLocalIterator()}
    known = spark.sparkContext.broadcast(top)
    kind = docs.schema["id"].dataType.simpleString()

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what is known already, and one for each of its other pre-tokens."""
        tool, table_ = PreTokens(shared.value), known.value
        for b in batches:
            rid, key, freq, size, base, ids = [], [], [], [], [], []
            for r, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = t.as_py() or ""
                tokens, n = tool.split(text)
                seen = Counter(tokens)
                known_, rest = 0, []
                for x, f in seen.items():
                    k = key_of(x)
                    if k in table_:
                        known_ += table_[k] * f
                    else:
                        rest.append((k, f))
                rid += [r] * (len(rest) + 1)
                # no pre-token: a control character and a digit never share one
                key += [f"\x00{r % 65536}", *(x for x, _ in rest)]
                freq += [0, *(f for _, f in rest)]
                size += [len(text.encode())] + [None] * len(rest)
                base += [n + known_] + [0] * len(rest)
                ids += [i] + [None] * len(rest)
                if len(rid) > 50_000:
                    yield rows(rid, ids, key, freq, base, size)
                    rid, key, freq, size, base, ids = [], [], [], [], [], []
            yield rows(rid, ids, key, freq, base, size)

    schema = f"rid long, id {kind}, pre_token string, freq long, base long, n_bytes long"
    id_type = to_arrow_type(docs.schema["id"].dataType)

    def rows(rid, ids, key, freq, base, size) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(ids, id_type), pa.array(key, pa.string()), pa.array(freq, pa.int64()), pa.array(base, pa.int64()), pa.array(size, pa.int64())], names=["rid", "id", "pre_token", "freq", "base", "n_bytes"])

    tail = counts if least is None else counts.where(level < least)
    parts = docs.mapInArrow(released(document), schema).join(tail.select("pre_token", "n"), "pre_token", "left")
    return parts.groupBy("rid").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("base") + F.col("freq") * F.coalesce("n", F.lit(0))).alias("n_tokens")).select("id", "n_bytes", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
