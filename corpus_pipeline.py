"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns what it keeps, with the columns of documents (the last stage adds the
probability that a document was sampled with).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import Scratch, fresh, quoted, table
from docquery.llm.decontam import contamination, digest_columns
from docquery.llm.mixing import mix
from docquery.llm.quality import quality_scores
from docquery.llm.simhash import near_duplicates
from docquery.llm.suffix import remove_repeats

#: SQL cannot express the classifier, the near-duplicate groups or byte-wise removal.
ORACLE_SQL = None

#: The most that sampling keeps of a cell that is at its target; less if a cell further below it could not be kept as often as its target asks for.
MIX_RATE = 1.0


def _count_chars(docs: DataFrame, text: Column) -> dict[str, Column]:
    """The text, and n_chars if there is such a column."""
    return {"text": text, **({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}


def _same(docs: DataFrame, changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of docs, whatever their names; some may have new values."""
    return [(changed or {}).get(c, quoted(c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go.

    Null, empty and wordless texts are rejected, null ids are judged by their
    text; rows with one text (repeated rows, ties) share their fate.  The
    whole of a long text is scored.  An empty table gives an empty one.
    """
    (keep,) = fresh(docs, "keep")
    return quality_scores(docs, keep_columns=True, names=("score", "posterior", "pattern", keep)).where(F.col(keep)).select(*_same(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Null and empty texts are one group; null ids come first; of rows alike in
    id and text one stays, and rows of one id are ordered by a hash of the
    text.  Whole texts are compared.  An empty table gives an empty one.
    """
    (kept,) = fresh(docs, "kept")
    return near_duplicates(docs, Scratch(spark, "near"), kept_col=kept).where(F.col(kept)).select(*_same(docs))


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more stay where they occur first and go elsewhere; a document of which nothing is left goes.

    First by id (null ids before all), a hash of the text and the position;
    repeated rows are one document.  Null and empty texts go, as nothing of
    them is left.  Matches are sought in whole texts.  An empty table gives an
    empty one.
    """
    kept, spans = fresh(docs, "kept", "spans")
    found = remove_repeats(docs, Scratch(spark, "repeats"), keep="first", as_text=True, kept_col=kept, spans_col=spans)
    text = F.when(F.size(spans) > 0, F.col(kept)).otherwise(F.col("text"))
    return found.where(F.trim(text) != "").select(*_same(docs, _count_chars(docs, text)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of benchmark passages go; from the others the passages are cut.

    Null and empty texts have no words and stay; each repeated row, and each
    row of one id (ties), is judged by its own text, the whole of it.  Without
    a benchmark, or documents, nothing changes.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"), carried=docs.columns, clean=True).where(~digest_columns()["contaminated"])
    of = {c: F.col("row")[c] for c in docs.columns}
    return found.select(*[c.alias(n) for n, c in (of | _count_chars(docs, F.coalesce(F.col("clean"), F.col("text")))).items()])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics have their target weights.

    A null source or language is a value of its own, "unknown"; null and empty
    texts have no weight and are kept at the rate; null ids, ties and repeated
    rows of one cell share their fate.  An empty table gives an empty one.
    """
    packed = docs.select("doc_id", "text", "source", "lang", F.struct(*map(quoted, docs.columns)).alias("row"))
    (probability,) = fresh(docs, "probability")
    return mix(packed, rate=MIX_RATE).where("_sampled").select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("_probability").alias(probability))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.cut(docs)
    return docs
