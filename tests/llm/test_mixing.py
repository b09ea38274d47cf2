import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquery.llm.common import Scratch
from docquery.llm.mixing import marginals, mix, rake


def shares(got):
    """Of the expected sample, by brute force over its rows."""
    total, out = 0.0, {}
    for r in got:
        x = r._tokens * r._probability
        total += x
        for d in ("_source", "_lang", "_topic"):
            out[d, r[d]] = out.get((d, r[d]), 0.0) + x
    return {k: v / total for k, v in out.items()}


@pytest.mark.parametrize("rate", [0.2, 0.5, 1.0])
def test_the_sample_has_its_target_shares(spark, rate):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mix(docs, rate=rate).select("_source", "_lang", "_topic", "_tokens", "_probability").collect()
    now, whole = {}, sum(r._tokens for r in got)
    for r in got:
        for d in ("_source", "_lang", "_topic"):
            now[d, r[d]] = now.get((d, r[d]), 0.0) + r._tokens / whole
    norm = {d: sum(v**0.5 for k, v in now.items() if k[0] == d) for d in ("_source", "_lang", "_topic")}
    found = shares(got)
    assert found == pytest.approx({k: v**0.5 / norm[k[0]] for k, v in now.items()}, abs=1e-6)
    assert max(r._probability for r in got) <= 1.0
    if rate == 1.0:
        reported = {(f"_{r.dimension}", r.value): (r.present, r.expected) for r in marginals(mix(docs, rate=rate)).collect()}
        assert {k: v[1] for k, v in reported.items()} == pytest.approx(found, abs=1e-9) and {k: v[0] for k, v in reported.items()} == pytest.approx(now, abs=1e-9)


def test_given_targets_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    found = shares(mix(docs, targets={"lang": wanted}, temper=1.0).collect())
    assert {v: found["_lang", v] for v in wanted} == pytest.approx(wanted, abs=1e-6)


def test_present_mix_is_kept(spark):
    cells = spark.createDataFrame([("a", "x", "t", 3.0), ("a", "y", "t", 1.0), ("b", "x", "t", 5.0), ("b", "y", "u", 0.0)], "_source string, _lang string, _topic string, w double")
    assert [round(r.factor, 9) for r in rake(cells, Scratch(spark, "t"), temper=1.0).collect()] == [1.0] * 4


def test_sampling_follows_the_probability(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    got = mix(docs, temper=0.0, rate=0.5)
    by = {r._source: (r.p, r.n) for r in got.groupBy("_source").agg(F.max("_probability").alias("p"), F.avg(F.col("_sampled").cast("int")).alias("n")).collect()}
    # a quarter of the tokens is to be a half: factors 2 and 2 / 3
    assert by["a"][0] == pytest.approx(1.0, abs=1e-6) and by["b"][0] == pytest.approx(1 / 3, abs=1e-6)
    assert by["b"][1] == pytest.approx(1 / 3, abs=0.02)


def test_nulls_ties_and_clashing_names(spark):
    rows = [(1, None, None, None), (None, "a b", "s", "en"), (2, "", "s", "en"), (2, "", "s", "en"), (3, "x " * 50000, None, "en")]
    df = spark.createDataFrame([(*r, 1.5, "z") for r in rows], "doc_id long, text string, source string, lang string, w double, factor string")
    df = df.withColumns({"_h": F.lit(7), "_tokens": F.lit("mine"), "source_": F.lit("kept"), "a.b": F.lit(3)})
    got = mix(df).collect()
    assert {(r._h, r.source_, r["a.b"]) for r in got} == {(7, "kept", 3)} and {r._tokens for r in got} == {0.0, 2.0, 50000.0}
    assert len(got) == 5 and all(0 <= r._probability <= 1 for r in got)
    assert mix(df.where("false")).count() == 0


def test_the_pipeline_samples_what_the_operator_does(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({"_tokens": F.lit("mine"), "probability": F.lit("mine")})
    kept = corpus_pipeline.mixture(spark, docs, "")
    assert kept.columns[: len(docs.columns)] == docs.columns and {(r._tokens, r.probability) for r in kept.collect()} == {("mine", "mine")}
    sampled = mix(docs, rate=corpus_pipeline.MIX_RATE).where("_sampled").select("doc_id", "_probability").collect()
    assert sorted((r[docs.columns.index("doc_id")], r[len(docs.columns)]) for r in kept.collect()) == sorted(map(tuple, sampled))
