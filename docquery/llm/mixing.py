"""Operator 6: mixing sources to target weights, DataFrame functions only.

Documents are reduced to cells of (source, language, topic) with their token
weights; iterative proportional fitting rakes the cells to the three target
marginals until they agree to ``TOLERANCE``, and every document is then sampled
with its cell's probability.  Only the cell table, aggregated before any
shuffle, takes part in the fitting.  It is written once, a row for each source;
a round is one aggregation of it, and what the driver holds between rounds is
one number for each pair of language and topic.  Sampling hashes the id, so it
is repeatable and needs no shuffle.

Targets are shares for each value of a dimension; values without one, and
dimensions without any, aim at their present share raised to ``temper`` (1
keeps the present mix, 0 makes all values equal), and a dimension's shares are
scaled to sum to one.  A cell's probability is rate * factor.  The rate is
``rate``, or less, so that no cell would need a probability over 1: nothing is
cut, and the expected shares of the sample are the raked ones (``marginals``
reports both).  The cell furthest below its target thus decides how much is
kept.  Targets that contradict one another (a value whose cells are all empty)
end after ``rounds`` with the topics' shares met.

Nulls: a null source or language is the value "unknown", a null text has no
tokens, a null id is sampled as an empty one.  Cells without tokens have factor
1 and the rate for a probability.  Repeated rows, and rows of one id in one
cell (ties), share their fate.  An empty table gives an empty one; of long
texts only marks and words are counted.  An input column that is named like a
result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.common import Scratch, fresh, quoted, table

DIMENSIONS = ("source", "lang", "topic")
#: Rounds of fitting at most, and by how much a marginal may miss its target, relatively, where they end.
ROUNDS = 40
TOLERANCE = 1e-9
TEMPER = 0.5
RATE = 0.5
SEED = "mix-1"
#: The cell table is broadcast up to this many rows, of three short strings and a number each; beyond, the join shuffles.
BROADCAST_CELLS = 100_000
WORD = "[^ \\t-\\r]+"


def topic_of(text: Column) -> Column:
    """A coarse topic by marks in the text: legal, contact, figures or prose."""
    return (
        F.when(F.contains(text, F.lit("icens")) | F.contains(text, F.lit("opyright")), "legal")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(text.rlike("[0-9][0-9][0-9]"), "figures")
        .otherwise("prose")
    )


def unit_hash(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def weigh(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", names: Sequence[str] = ("_source", "_lang", "_topic", "_tokens")) -> DataFrame:
    """The rows with source, language, topic and tokens under ``names``."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    made = (F.coalesce(quoted(source_col).cast("string"), F.lit("unknown")), F.coalesce(quoted(lang_col).cast("string"), F.lit("unknown")), topic_of(text), F.regexp_count(text, F.lit(WORD)).cast("double"))
    return docs.select("*", *[c.alias(n) for c, n in zip(made, names, strict=True)])


def aims(now: Mapping[str, float], given: Mapping[str, float] | None, temper: float) -> dict[str, float]:
    """The target weight of each value of a dimension with its present weight."""
    total = sum(now.values())
    want = {v: (given or {}).get(v, (w / total) ** temper) if w > 0 else 0.0 for v, w in now.items()}
    whole = sum(want.values())
    return {v: x / whole * total if whole > 0 else 0.0 for v, x in want.items()}


def rake(cells: DataFrame, scratch: Scratch, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER) -> DataFrame:
    """cells(_source, _lang, _topic, w) -> the same with ``factor``."""
    cells = scratch.cut(cells)
    pairs = sorted((r._lang, r._topic, r.w) for r in cells.groupBy("_lang", "_topic").agg(F.sum("w").alias("w")).collect())
    if not pairs:
        return cells.withColumn("factor", F.lit(1.0))
    total, of = sum(w for _, _, w in pairs), {p[:2]: i for i, p in enumerate(pairs)}
    now = [{}, {}]
    for *values, w in pairs:
        for d, v in zip(now, values, strict=True):
            d[v] = d.get(v, 0.0) + w
    aim = [aims(now[0], (targets or {}).get("lang"), temper), aims(now[1], (targets or {}).get("topic"), temper)]
    share = F.pow(F.col("m") / F.lit(total or 1.0), temper)
    if given := (targets or {}).get("source"):
        known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in given.items()))
        share = F.coalesce(F.try_element_at(known, F.col("_source")), share)
    index = cells.sparkSession.createDataFrame([(*k, i) for k, i in of.items()], "_lang string, _topic string, k int")
    rows = cells.join(F.broadcast(index), ["_lang", "_topic"]).groupBy("_source").agg(F.sum("w").alias("m"), F.collect_list(F.struct("k", "w")).alias("cells"))
    rows = scratch.cut(rows.select("_source", "m", F.when(F.col("m") > 0, share).otherwise(0.0).alias("share"), "cells"))
    whole = rows.agg(F.sum("share")).first()[0] or 1.0
    scale = [dict.fromkeys(now[0], 1.0), dict.fromkeys(now[1], 1.0)]

    def of_source() -> Column:
        """Each source's factor, given those of the other dimensions."""
        other = F.array(*[F.lit(scale[0][lang] * scale[1][topic]) for lang, topic in of])
        got = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["w"] * F.get(other, x["k"]))
        aim_ = F.col("share") / F.lit(whole) * F.lit(total)
        return F.when((got > 0) & (aim_ > 0), aim_ / got).otherwise(1.0)

    last = of_source()
    for _ in range(rounds):
        last = of_source()
        sums = rows.select(last.alias("a"), F.explode("cells").alias("c")).groupBy("c.k").agg(F.sum(F.col("c.w") * F.col("a")).alias("w")).collect()
        weight, miss = {r.k: r.w for r in sums}, 0.0
        for d in (0, 1):
            got = dict.fromkeys(now[d], 0.0)
            for pair, k in of.items():
                got[pair[d]] += weight.get(k, 0.0) * scale[0][pair[0]] * scale[1][pair[1]]
            for v, w in got.items():
                if w > 0 and aim[d][v] > 0:
                    scale[d][v] *= aim[d][v] / w
                    miss = max(miss, abs(aim[d][v] / w - 1))
        if miss < TOLERANCE:
            break
    # the sources' factors are those that the last round fitted the others to
    other = F.array(*[F.lit(scale[0][lang] * scale[1][topic]) for lang, topic in of])
    fitted = rows.select("_source", last.alias("a"), F.explode("cells").alias("c")).select("_source", F.col("c.k").alias("k"), F.col("c.w").alias("w"), (F.col("a") * F.get(other, F.col("c.k"))).alias("factor"))
    return fitted.join(F.broadcast(index), "k").select("_source", "_lang", "_topic", "w", F.when(F.col("w") > 0, F.col("factor")).otherwise(1.0).alias("factor"))


NAMES = ("_source", "_lang", "_topic", "_tokens", "_probability", "_sampled")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: Mapping[str, Mapping[str, float]] | None = None, rate: float = RATE, rounds: int = ROUNDS, temper: float = TEMPER) -> DataFrame:
    """Every row with _source, _lang, _topic, _tokens, _probability and _sampled."""
    source, lang, topic, tokens, s, l, t, factor = fresh(docs, "source_", "lang_", "topic_", "tokens_", "s_", "l_", "t_", "factor_")
    rows = weigh(docs, text_col, source_col, lang_col, (source, lang, topic, tokens))
    scratch = Scratch(docs.sparkSession, "cells")
    cells = rows.groupBy(F.col(source).alias("_source"), F.col(lang).alias("_lang"), F.col(topic).alias("_topic")).agg(F.sum(tokens).alias("w"))
    cells = scratch.cut(rake(cells, scratch, targets, rounds, temper))
    # cells without tokens do not weigh
    stats = cells.agg(F.max(F.when(F.col("w") > 0, F.col("factor"))).alias("most"), F.count("*").alias("n")).first()
    rate = min(rate, 1 / (stats.most or 1.0))
    cells = cells.select(F.col("_source").alias(s), F.col("_lang").alias(l), F.col("_topic").alias(t), F.col("factor").alias(factor))
    if stats.n <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    out = rows.join(cells, (F.col(source) == F.col(s)) & (F.col(lang) == F.col(l)) & (F.col(topic) == F.col(t)), "left")
    probability = F.least(F.lit(1.0), F.lit(rate) * F.col(factor))
    made = (F.col(source), F.col(lang), F.col(topic), F.col(tokens), probability, unit_hash(quoted(id_col)) < probability)
    return out.select(*[quoted(c) for c in docs.columns if c not in NAMES], *[c.alias(n) for c, n in zip(made, NAMES, strict=True)])


def marginals(mixed: DataFrame) -> DataFrame:
    """(dimension, value, present, expected) of the result of ``mix``: the share of each value in the tokens, and in the expected tokens of the sample."""
    cells = mixed.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("w"), F.sum(F.col("_tokens") * F.col("_probability")).alias("p"))
    whole = cells.agg(F.sum("w").alias("w"), F.sum("p").alias("p")).first()
    by = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"_{d}").alias("value")) for d in DIMENSIONS])).alias("d")
    return cells.select(by, "w", "p").groupBy("d.dimension", "d.value").agg((F.sum("w") / F.lit(whole.w or 1.0)).alias("present"), (F.sum("p") / F.lit(whole.p or 1.0)).alias("expected"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").cast("long").alias("n_words"), F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"))


def _sql() -> str:
    steps, last, n = [], "t", 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            n += 1
            steps.append(f"f{n} AS (SELECT source, lang, topic, w, t_source, t_lang, t_topic, CASE WHEN now > 0 AND t_{d} > 0 THEN factor * t_{d} / now ELSE factor END AS factor FROM (SELECT *, sum(w * factor) OVER (PARTITION BY {d}) AS now FROM {last}))")
            last = f"f{n}"
    each = lambda x: ", ".join(x.format(d=d) for d in DIMENSIONS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    CASE WHEN contains(x, 'icens') OR contains(x, 'opyright') THEN 'legal' WHEN contains(x, '@') THEN 'contact' WHEN regexp_matches(x, '[0-9][0-9][0-9]') THEN 'figures' ELSE 'prose' END AS topic,
    len(regexp_extract_all(x, '[^ \\t-\\r]+')) AS tokens FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS w FROM d GROUP BY ALL),
m AS (SELECT *, {each("sum(w) OVER (PARTITION BY {d}) AS m_{d}")}, sum(w) OVER () AS total FROM c),
s AS (SELECT *, {each(f"CASE WHEN m_{{d}} > 0 THEN pow(m_{{d}} / total, {TEMPER}) ELSE 0 END AS s_{{d}}")} FROM m),
n AS (SELECT *, {each("sum(CASE WHEN m_{d} > 0 THEN s_{d} * w / m_{d} ELSE 0 END) OVER () AS n_{d}")} FROM s),
t AS (SELECT source, lang, topic, w, {each("CASE WHEN n_{d} > 0 THEN s_{d} / n_{d} * total ELSE 0 END AS t_{d}")}, CAST(1 AS DOUBLE) AS factor FROM n),
{", ".join(steps)},
r AS (SELECT least({RATE}, 1 / max(CASE WHEN w > 0 THEN factor END)) AS rate FROM {last}),
p AS (SELECT source, lang, topic, least(1.0, rate * CASE WHEN w > 0 THEN factor ELSE 1 END) AS probability FROM {last}, r)
SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS n_words, round(probability, 6) AS probability,
  CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 < probability AS sampled
FROM d JOIN p USING (source, lang, topic)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_mix_sources": op6_mix_sources}
SQL: dict[str, str] = {"op6_mix_sources": _sql()}
