import os
import random

import numpy as np
import pytest

from docquery.llm.common import Scratch
from docquery.llm.suffix import remove_repeats, repeat_groups


def brute(rows, length, keep="none"):
    """(id, kept, spans) from all windows."""
    at = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        t = (rows[i][1] or "").encode()
        for p in range(len(t) - length + 1):
            at.setdefault(t[p : p + length], []).append((i, p))
    out = []
    for i, (d, t) in enumerate(rows):
        t = (t or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            where = at[t[p : p + length]]
            if len(where) > 1 and (keep == "none" or where[0] != (i, p)):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((d, bytes(x for x, g in zip(t, gone, strict=True) if not g), spans))
    return sorted(out, key=str)


def run(spark, rows, length, **kw):
    df = spark.createDataFrame([(*r, "m", 3, "s", 1) for r in rows], "doc_id long, text string, m string, h int, spans string, id int")
    got = remove_repeats(df, Scratch(spark, "t"), length=length, **kw)
    return sorted(((r.doc_id, bytes(r._kept), len(r._spans) // 2) for r in got.collect()), key=str)


def corpus(seed, n, length):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(60) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s) // 2)
            parts += [s[a : a + rnd.randint(length // 2, 3 * length)], text(rnd.randint(0, 20))]
        rows.append((i, "".join(parts)))
    for i in range(8):
        w = rows[i][1]
        p = rnd.randint(0, len(w))
        rows.append((100 + i, w[:p] + "X" + w[p:]))
    rows += [(200, None), (201, ""), (202, "ab " * 200), (203, "x" * (length + 3)), (204, "q" * length), (205, shared[0]), (206, shared[0]), (None, shared[1]), (208, "ab " * 90 + "tail"), (209, "z" * 5000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed, 40, 80)
    assert run(spark, rows, 80) == brute(rows, 80)
    assert run(spark, rows, 80, bucket=3) == brute(rows, 80)
    assert run(spark, rows, 80, keep="first") == brute(rows, 80, "first")


def test_wide_buckets_keep_the_first(spark):
    rows = corpus(5, 40, 80)
    assert run(spark, rows, 80, keep="first", bucket=1) == brute(rows, 80, "first")


def test_real_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, docs, 200) == brute(docs, 200)


def test_repeated_rows_and_empty(spark):
    rows = [(1, "u" * 40 + "v" * 60), (1, "u" * 40 + "v" * 60), (2, "w" * 50)]
    assert run(spark, rows, 80) == brute(rows, 80)
    assert run(spark, [], 80) == []


def thue_morse(n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_texts_that_polynomials_take_for_equal(spark, n):
    a, b = thue_morse(n)
    rows = [(1, a), (2, b), (3, "x" + a[:700]), (4, "y" * 1500 + b)]
    for bucket in (1, 2048):
        assert run(spark, rows, 1024, bucket=bucket) == brute(rows, 1024)


def test_prefixes_of_one_hash_are_ranked_by_their_bytes(monkeypatch):
    """As if the hashes of all prefixes were equal."""
    from docquery.llm import suffix

    texts = [b"abcdefgh" * 4, b"zbcdefgh" * 4, b"abcdefgh" * 2 + b"abcdxfgh" * 2]
    n = np.array([len(t) - 9 for t in texts])
    plain = suffix.SuffixArray(texts, n, np.zeros(3, dtype=np.int64), 10)
    monkeypatch.setattr(suffix, "range_hash", lambda p, s, e: np.zeros(len(s), dtype=np.uint64))
    other = suffix.SuffixArray(texts, n, np.zeros(3, dtype=np.int64), 10)
    joined = b"".join(texts)
    for sa in (plain, other):
        for i, d in enumerate(sa.lcp):
            a, b = (joined[sa.start[k] : sa.base[sa.carrier[k]] + len(texts[sa.carrier[k]])] for k in (i, i + 1))
            same = len(os.path.commonprefix([a, b]))
            assert d == (same if same >= 10 else 0)
    repeated = lambda sa: {(int(sa.carrier[k]), int(sa.offset[k])) for i, d in enumerate(sa.lcp) if d for k in (i, i + 1)}
    assert repeated(plain) == repeated(other)


def test_ids_of_other_types_and_long_texts(spark):
    rnd = random.Random(3)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(700_000))
    df = spark.createDataFrame([("a", body, 1), ("b", "new " + body[300_000:300_500] + " end", 2), (None, None, 3), ("c", "", 4)], "doc_id string, text string, _kept int")
    got = {r.doc_id: r for r in remove_repeats(df, Scratch(spark, "t")).collect()}
    assert got["a"]._spans == [300_000, 300_500] and bytes(got["b"]._kept) == b"new  end" and bytes(got[None]._kept) == b"" and got["c"]._spans == []


def test_groups_have_all_occurrences(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs off into the wood " * 1
    rows = [(i, f"{i * 7919}" * 9 + passage * (1 if i else 2) + f"{i * 104729}" * 9) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeat_groups(df, Scratch(spark, "t"), length=40).collect()
    places = {}
    text = dict(rows)
    for r in got:
        places.setdefault(text[r.id][r.start : r.start + r.size], set()).add((r.id, r.start))
    assert places
    for s, where in places.items():
        every = {(i, p) for i, t in rows for p in range(len(t)) if t.startswith(s, p)}
        assert where <= every and len(every) > 1
