import random

import numpy as np

import docquery.llm.simhash as module
from docquery.llm.common import Scratch
from docquery.llm.simhash import FP_WORDS, alike, bits_apart, forest, near_duplicates, radius_of, search, set_fingerprints, verified


def packed(sets):
    return np.array([x for s in sets for x in sorted(s)], dtype=np.int32), np.cumsum([0] + [len(s) for s in sets])


def values(rnd, n):
    return rnd.sample(range(-(2**31), 2**31), n)


def test_links_of_the_stage_come_from_the_trees(spark):
    body = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(1, " ".join(body)), (2, " ".join([*body, "x"])), (3, "another text of a few words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_duplicates(df, Scratch(spark, "t")).where("_kept").collect()) == [1, 3]
    plain = module.search
    try:
        module.search = lambda *_: iter(())
        assert near_duplicates(df, Scratch(spark, "t")).where("_kept").count() == 3
    finally:
        module.search = plain


def test_fingerprints_are_majorities_of_the_shingles():
    rnd = random.Random(1)
    sets = [values(rnd, n) for n in (1, 0, 2, 5, 40000, 0, 3)]
    flat, at = packed(sets)
    got = set_fingerprints(flat, at)
    for i, s in enumerate(sets):
        for k in range(FP_WORDS):
            h = [int(x) for x in module.mix(np.array([(x % 2**32) + (k + 1 << 32) for x in s], dtype=np.uint64))]
            assert int(got[i, k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_sets_at_the_threshold_lie_within_the_radius():
    rnd = random.Random(2)
    for common, only_a, only_b in ((4, 0, 1), (12, 3, 0), (20, 3, 2), (160, 20, 20)):
        sets = []
        for _ in range(1000):
            v = values(rnd, common + only_a + only_b)
            sets += [v[: common + only_a], v[:common] + v[common + only_a :]]
        fp = set_fingerprints(*packed(sets))
        assert bits_apart(fp, np.arange(0, 2000, 2), np.arange(1, 2000, 2)).max() <= radius_of(0.8) == 90


def test_trees_find_all_similar_pairs_of_their_shards():
    """Shards of one set, of strangers, of near copies and of sets that are equal, against all pairs."""
    rnd = random.Random(3)
    sets, root = [], []
    for n, kind in ((1, "far"), (60, "far"), (90, "near"), (300, "equal"), (2, "near"), (40, "tiny")):
        base = values(rnd, 200)
        root += [len(sets)] * n
        for _ in range(n):
            own = {"far": values(rnd, 50), "near": base[rnd.randrange(25) :] + values(rnd, rnd.randrange(25)), "equal": base, "tiny": rnd.sample(base[:6], rnd.randint(1, 6))}
            sets.append(own[kind])
    flat, at = packed(sets)
    root = np.array(root)
    fp = set_fingerprints(flat, at)
    for at_once in (1 << 18, 500):
        got = set()
        for a, b in search(fp, root, forest(fp, root), radius_of(0.8), at_once):
            a, b = verified(flat, at, root, a, b, 0.8)
            assert not got & {*zip(a.tolist(), b.tolist(), strict=True)}
            got |= {*zip(a.tolist(), b.tolist(), strict=True)}
        expected = set()
        for lo in np.unique(root):
            a, b = alike(flat, at[np.flatnonzero(root == lo)[0] : np.flatnonzero(root == lo)[-1] + 2], 0.8)
            expected |= {*zip((a + lo).tolist(), (b + lo).tolist(), strict=True)}
        assert got == expected
