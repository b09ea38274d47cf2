import random
import re

import pytest

from docquery.llm.common import Scratch
from docquery.llm.substring import remove_repeats


def brute(rows, length):
    docs = [(i, [w for w in re.split("[ \t-\r]+", t or "") if w]) for i, t in rows]
    least = {}
    for i, w in docs:
        if i is not None:
            for p in range(len(w) - length + 1):
                k = tuple(w[p : p + length])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - length + 1):
            a = least.get(tuple(w[p : p + length]))
            if a is not None and (i is None or a < i):
                gone |= set(range(p, p + length))
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out, key=str)


def run(spark, rows, length=13):
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id long, text string, h string, list int")
    got = remove_repeats(df, Scratch(spark, "t"), length=length).collect()
    assert all(r.n_removed == sum(z - a for a, z in zip(r.spans[::2], r.spans[1::2], strict=True)) for r in got)
    return sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in got), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 4)))
    shared = [[word() for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rnd.randint(0, 20))]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, 50)
            w += s[a : a + rnd.randint(5, 40)] + [word() for _ in range(rnd.randint(0, 9))]
        rows.append((rnd.randint(-50, 1 << 40) if i % 9 else i, rnd.choice([" ", "\n", " \t "]).join(w)))
    rows += [(7001, None), (7002, ""), (7003, " \n "), (7004, "x " * 4000), (7005, "x " * 13), (7006, "x " * 12), (None, "x " * 20), (None, rows[3][1]), (7007, rows[5][1]), (7007, rows[5][1]), (7007, rows[6][1]), (7008, "x y " * 14), (7009, "x y " * 15)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows, 13)


def test_other_lengths(spark):
    rows = corpus(3)
    for n in (4, 6):
        assert run(spark, rows, n) == brute(rows, n)


def thue_morse(n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_polynomials_take_for_equal(spark, n):
    a, b = thue_morse(n)
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{b} {tail} x"), (4, f"{a} {b} " * 12), (5, f"{b} {a} " * 12)]
    assert run(spark, rows) == brute(rows, 13)


def test_ids_of_other_types_and_the_last_one(spark):
    last = (1 << 63) - 1
    rows = [(3, "x " * 20), (last, "x " * 20), (None, "y " * 20), (last, "z " * 14)]
    assert run(spark, rows) == brute(rows, 13)
    named = spark.createDataFrame([("a", "x " * 20), ("b", "x " * 20), (None, "x " * 13), ("", None)], "doc_id string, text string")
    assert sorted(((r.id or "", r.n_removed) for r in remove_repeats(named, Scratch(spark, "t")).collect())) == [("", 0), ("", 13), ("a", 0), ("b", 20)]


def test_a_text_of_several_slices(spark):
    rnd = random.Random(9)
    w = [f"{rnd.randrange(10**6)}" for _ in range(120_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:60_000], "new", *w[60_000:]])), (3, " ".join(w[90_000:90_040]))]
    assert run(spark, rows) == brute(rows, 13)


def test_empty(spark):
    assert run(spark, []) == []
