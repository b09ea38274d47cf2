import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docquery.llm.quality import CLASS, DIM, LABELLERS, digits, fit, fit_votes, op4_quality, quality_scores


def run(spark, rows):
    df = spark.createDataFrame([(*r, "p", 1.0) for r in rows], "doc_id long, text string, pattern string, score double")
    return sorted((tuple(r) for r in quality_scores(df).collect()), key=str)


def test_labels_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_scores(docs).withColumnRenamed("id", "doc_id").join(labels, "doc_id").select("quality", "keep").toPandas()
    assert (got.keep[got.quality == 1]).mean() > 0.99
    assert (~got.keep[got.quality == 0]).mean() > 0.97


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(3)
    n, m = 20000, len(LABELLERS)
    good = rng.random(n) < 0.8
    wrong = np.linspace(0.0005, 0.003, m)
    kind = rng.integers(0, m, n)[:, None]  # each kind of bad text is seen by two labellers
    seen = rng.random((n, m)) < np.where(good[:, None], wrong, np.where((kind == np.arange(m)) | ((kind + 1) % m == np.arange(m)), 0.9, 0.03))
    v = np.where(seen, 0, 1)
    v[rng.random((n, m)) < 0.1] = 2
    pattern, of, counts = np.unique((v * 3 ** np.arange(m)[::-1]).sum(1), return_inverse=True, return_counts=True)
    assert (digits(pattern) >= 0).all()
    post, tables = fit_votes(pattern, counts.astype(float))
    told = seen.any(1) & (v == 0).any(1)
    assert ((post[of] > 0.5) == good)[told].mean() > 0.9 and post[of][~(v == 0).any(1)].min() > 0.8
    assert abs(tables[1, :, 0] - 0.9 * wrong).max() < 0.02
    assert abs((post * counts).sum() / counts.sum() - 0.8) < 0.06


def test_nulls_ties_and_extremes(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    extra = [(1001, None), (1002, ""), (1003, " \n"), (1004, "ha### " * 40000), (1005, "ha### " * 50), (1005, "ha### " * 50), (None, docs[0][1])]
    got = run(spark, docs + extra)
    assert len(got) == len(docs) + len(extra)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert all(by[i][0][1] == 0.0 and not by[i][0][4] for i in (1001, 1002, 1003))
    assert not by[1004][0][4] and len(by[1005]) == 2 and by[1005][0] == by[1005][1]
    assert by[None][0][1] == by[docs[0][0]][0][1]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0.0, 0.0, -1, False)]


LETTERS = {*range(65, 91), *range(97, 123), *range(128, 256)}
SIGNS = set(range(128)) - LETTERS - set(b"0123456789 \t\n\v\f\r.,;:'\"()-")


def plain_pattern(raw):
    """The votes on one text, word after word."""
    w = raw.split()
    if not w:
        return -1, 0, 0
    n, again = len(w), sum(a == b for a, b in zip(w, w[1:], strict=False))
    inside, letters = sum(map(len, w)), [[b for b in x if b in LETTERS] for x in w]
    stat = {
        "marked": sum(len(x) > 1 and x[-1] in SIGNS and x[-1] == x[-2] for x in w) / (n + 5),
        "shouted": sum(len(x) > 1 and all(65 <= b <= 90 for b in x) for x in letters) / (n + 5),
        "bare": sum(not any(b in LETTERS or 48 <= b <= 57 for b in x) for x in w) / (n + 5),
        "repeated": again / (n + 5),
        "variety": len(set(w)) / n * max(1, math.log2(n / 500)) if n >= 40 else None,
        "letters": 1 - (inside - sum(map(len, letters))) / (inside + 80),
        "symbols": sum(b in SIGNS for x in w for b in x) / (inside + 80),
    }
    out = 0
    for name, bad, good in LABELLERS:
        x, sign = stat[name], 1 if bad > good else -1
        out = out * 3 + (2 if x is None else 0 if sign * x >= sign * bad else 1 if sign * x <= sign * good else 2)
    return out, again, n


def plain_posterior(counts):
    """EM over vote patterns in plain loops: parts of the bad class, one for each labeller, and the good class."""
    m = len(LABELLERS)
    vote = {p: [p // 3 ** (m - 1 - k) % 3 for k in range(m)] for p in counts}
    r = {}
    for p, v in vote.items():
        b = v.count(0)
        r[p] = [0.9 * (x == 0) / b for x in v] + [0.1] if b else [0.03 / m] * m + [0.97]
    for _ in range(200):
        prior, table = [], []
        for k in range(m + 1):
            mass = sum(r[p][k] * c for p, c in counts.items())
            prior.append((mass + 0.1) / (sum(counts.values()) + 0.1 * (m + 1)))
            table.append([[(0.3 + sum(r[p][k] * c for p, c in counts.items() if vote[p][j] == x)) / (0.9 + mass) for x in range(3)] for j in range(m)])
        new = {}
        for p, v in vote.items():
            like = [prior[k] * math.prod(table[k][j][v[j]] for j in range(m)) for k in range(m + 1)]
            new[p] = [x / sum(like) for x in like]
        moved = max(abs(x - y) for p in r for x, y in zip(new[p], r[p], strict=True))
        r = new
        if moved < 1e-6:
            break
    return {p: x[m] for p, x in r.items()}


def plain_score(raw, again, n, weights):
    grams = Counter()
    for i in range(len(raw) - 3):
        code = 0
        for b in raw[i : i + 4]:
            code = code * 32 + int(CLASS[b])
        grams[(code * 2654435761 >> 7) % (DIM - 2)] += 1
    size = sum(grams.values()) + 80
    z = weights[DIM] + sum(weights[k] * math.sqrt(c / size) for k, c in grams.items()) + weights[DIM - 1] * math.sqrt(again / (n + 5))
    return 1 / (1 + math.exp(-max(-30, min(30, z)))) if n else 0.0


def test_registered_query_matches_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = docs.select(F.col("doc_id").alias("id"), "text")
    weights = fit(base)[2]
    got = {r.doc_id: r for r in op4_quality(spark, "/root/testdata/sf0.001").collect()}
    rows = {r.id: (r.text or "").encode() for r in base.collect()}
    seen = {i: plain_pattern(t) for i, t in rows.items()}
    good = plain_posterior(Counter(p for p, _, _ in seen.values() if p >= 0))
    assert got.keys() == rows.keys()
    for i, (pattern, again, n) in seen.items():
        assert got[i].pattern == pattern, i
        assert abs(got[i].posterior - good.get(pattern, 0.0)) < 1e-4
        score = plain_score(rows[i], again, n, weights)
        assert abs(got[i].score - score) < 1e-6 and got[i].keep == (got[i].score >= 0.3)
