import re

import numpy as np
from pyspark.sql import functions as F

from docquery.llm.langid import SEGMENT, Network, held_out, languages, learn, op2_language_id, pack, segments


def test_gradients_match_differences():
    net = Network(3, hidden=4)
    for k, v in net.w.items():
        net.w[k] = v.astype(np.float64)
    data = np.frombuffer(b"abcdefabbcxyz", dtype=np.uint8)
    text, mask = pack(data, np.array([0, 6, 10]), np.array([6, 10, 13]))
    label = np.array([0, 2, 1])
    _, g = net.gradients(text, mask, label)
    rng = np.random.default_rng(1)
    for k, v in net.w.items():
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in v.shape)
            if k.startswith("x"):
                i = (int(text[0, rng.integers(0, 6)]), i[1])
            keep, eps = v[i], 1e-4
            v[i] = keep + eps
            up = net.gradients(text, mask, label)[0]
            v[i] = keep - eps
            down = net.gradients(text, mask, label)[0]
            v[i] = keep
            assert abs((up - down) / (2 * eps) - g[k][i]) < 2e-3


def test_held_out_accuracy(spark):
    got = op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_nulls_ties_and_extremes(spark):
    rows = [(i, "the cat and dog house" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 ?! …", "de"), (103, "é" * 100000, None), (104, "the cat", None), (104, "the cat", None), (None, "der hund", "de")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = languages(df, F.lit(True), steps=150).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[103].lang_pred in ("en", "de") and by[104].lang_pred == "en" and by[None].lang_pred == "de"
    assert [r.lang_pred for r in got if r.id == 104] == ["en", "en"]


def test_held_out_rows_are_never_learned(spark):
    df = spark.createDataFrame([(i, "abc def", "x" if r else "y") for i in range(200) for r in [i % 3]], "doc_id long, text string, lang string")
    out = df.where(held_out())
    assert {r.lang_pred for r in languages(out, ~held_out(), steps=5).collect()} == {"und"}
    assert languages(df.where("false"), ~held_out()).count() == 0


def plain_prediction(net, langs, text):
    """One byte after the other, one word after the other."""
    hidden, w = net.hidden, {k: v.astype(float) for k, v in net.w.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(codes, d):
        h, out = np.zeros(hidden), []
        for c in codes:
            x, g = w[f"x{d}"][c], h @ w[f"u{d}"]
            z, r = sig(x[:hidden] + g[:hidden]), sig(x[hidden : 2 * hidden] + g[hidden : 2 * hidden])
            h = (1 - z) * np.tanh(x[2 * hidden :] + r * g[2 * hidden :]) + z * h
            out.append(h)
        return out

    lower = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    total, n = np.zeros(len(langs)), 0
    for word in re.findall(r"[^\x00-\x60\x7b-\x7f]+", lower):
        pieces, raw = [], word.encode()
        while raw:  # the next piece begins at the character that holds the next multiple of SEGMENT
            cut = min(len(raw), SEGMENT * (len(pieces) + 1) - sum(map(len, pieces)))
            while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            pieces.append(raw[:cut])
            raw = raw[cut:]
        for piece in pieces:
            for a, b in zip(states(piece, 0), states(piece[::-1], 1)[::-1], strict=True):
                o = np.concatenate([a, b]) @ w["v"] + w["c"]
                total += o - o.max() - np.log(np.exp(o - o.max()).sum())
                n += 1
    if not re.search(r"[^\W\d_]", text or ""):
        return "und", 0.0, n
    p = np.exp(total / max(n, 1) - (total / max(n, 1)).max())
    p /= p.sum()
    return langs[int(p.argmax())], float(p.max()), n


def test_registered_query_matches_a_plain_network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs, net = learn(docs, ~held_out())
    got = {r.doc_id: r for r in op2_language_id(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in [r for r in rows if len(r.text or "") < 4000]:
        lang, score, n = plain_prediction(net, langs, r.text)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-3 and got[r.doc_id].n_positions == n, r.doc_id


def test_pieces_end_with_characters():
    for word in ("é" * 50, "aé" * 30, "日本語" * 20, "x" * 100, "🙂" * 40, "a" + "🙂" * 40):
        raw = np.frombuffer(f"b {word} c".encode(), dtype=np.uint8)
        s, e, row = segments(raw, np.array([0, len(raw)]))
        own = [raw[a:z].tobytes().decode() for a, z in zip(s, e, strict=True)]
        assert own[0] == "b" and own[-1] == "c" and "".join(own[1:-1]) == word and (row == 0).all()
        assert max(len(x.encode()) for x in own) <= SEGMENT + 3
