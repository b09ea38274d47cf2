import random
import re

import numpy as np
import pytest

import corpus_pipeline
from docquery.llm.common import Scratch, table
from docquery.llm.simhash import alike, near_duplicates

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()


def groups(rows):
    """Smallest id of each group of texts linked at 0.8, by brute force."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u == 0 or len(sets[i] & sets[j]) >= 0.8 * u:
                comp[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(find(i), []).append(d)
    return sorted(min(v) for v in out.values())


def corpus(seed, copies=25):
    rnd = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 300))]
        rows.append(base)
        for _ in range(copies if g < 3 else rnd.randint(0, 4)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 60))):
                w[rnd.randrange(len(w))] = f"z{rnd.randint(0, 9999)}"
            rows.append(w)
    rows += [[], [], ["One"], ["one"], ["x"] * 5000]
    rnd.shuffle(rows)
    return [(i * 3, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("seed", "size"), [(1, 1024), (2, 10), (3, 4)])
def test_near_duplicates_match_brute_force(spark, seed, size):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "f", 1, 2, 777) for r in rows], "doc_id long, text string, fp string, i int, first int, _h long")
    got = near_duplicates(df, Scratch(spark, "t"), shard_size=size)
    assert got.columns == ["doc_id", "text", "fp", "i", "first", "_h", "_kept"] and got.count() == len(rows)
    assert got.select("fp", "i", "first", "_h").distinct().collect() == [("f", 1, 2, 777)]
    assert sorted(r.doc_id for r in got.where("_kept").collect()) == groups(rows)


def test_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None), (4, "")], "doc_id long, text string")
    kept = near_duplicates(df, Scratch(spark, "t")).where("_kept").collect()
    assert len(kept) == 2
    assert near_duplicates(df.where("false"), Scratch(spark, "t")).count() == 0


def test_stages_keep_the_columns_and_do_their_work(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    scratch = Scratch(spark, "t")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.cut(stage(spark, docs, sf))
        if name != "mixture":
            assert out.schema.simpleString() == docs.schema.simpleString()
        seen[name] = {r.doc_id: r.text for r in out.collect()}
        assert set(seen[name]) <= set(r.doc_id for r in docs.select("doc_id").collect())
        docs = out
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in seen["quality"] for i in good) >= 0.98 * len(good)
    assert sum(i in seen["quality"] for i, q in labels.items() if q == 0) <= 3
    assert len({t.lower() for t in seen["near_dedup"].values()}) == len(seen["near_dedup"])
    rows = sorted(seen["quality"].items())
    assert sorted(seen["near_dedup"]) == groups(rows)
    windows = {}
    for i, t in seen["repeat_dedup"].items():
        raw = t.encode()
        if t == texts[i]:
            for p in range(len(raw) - 199):
                windows.setdefault(raw[p : p + 200], []).append(i)
    assert all(len(v) == 1 for v in windows.values())
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    items = [tuple(word.findall(r.text.lower()))[:13] for r in table(spark, sf, "benchmark").collect()]
    joined = [" " + " ".join(word.findall(t.lower())) + " " for t in seen["decontaminate"].values()]
    assert not any(f" {' '.join(x)} " in t for x in items if len(x) == 13 for t in joined)
    assert 0 < len(seen["mixture"]) <= len(seen["decontaminate"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_in_any_column(spark, tmp_path):
    rows = [(1, "The cat sat on the mat and looked at the dog.", None, None, None), (None, "A house stands by the sea, and the wind is cold.", "en", "s", 3), (2, None, "en", "s", 1), (3, "", None, "s", 0), (4, "word " * 30000, "en", None, 5)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got <= {1, None}


def star(copies, words=300, edits=5, seed=4):
    """An original and copies that are like it, but not like one another."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = [base]
    for _ in range(copies):
        w = list(base)
        for k in rnd.sample(range(0, words - 10, 10), edits):
            w[k + rnd.randrange(5) + 3] = f"z{rnd.randrange(10**9)}"
        rows.append(w)
    rnd.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_a_group_held_together_by_its_original_keeps_one_row(spark):
    df = spark.createDataFrame(star(3000), "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in near_duplicates(df, Scratch(spark, "t")).where("_kept").collect()] == [0]


def thue_morse(n):
    """Two complementary words that every polynomial hash modulo a power of two takes for equal, if they are long."""
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_texts_without_a_common_word_are_apart(spark, n):
    a, b = thue_morse(n)
    df = spark.createDataFrame([(1, f"{a} {b} {a}{a} {b}{a} x y"), (2, f"{b} {a} {b}{b} {a}{b} x y"), (3, a), (4, b)], "doc_id long, text string")
    assert near_duplicates(df, Scratch(spark, "t")).where("_kept").count() == 4


def test_groups_are_whole_however_small_the_shards(spark):
    rows = corpus(2) + [(10**6 + i, t) for i, t in star(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_duplicates(df, Scratch(spark, "t"), shard_size=10).where("_kept").collect()) == groups(rows)


def test_all_similar_pairs_of_a_shard_are_found():
    rnd = random.Random(6)
    for n, least in ((2, 1), (3, 1), (40, 1), (90, 200)):
        pool = rnd.sample(range(-(2**31), 2**31), 400)
        sets = [sorted(rnd.sample(pool[:least + 20], least) if i % 3 else rnd.sample(pool, rnd.randint(1, 9))) for i in range(n)]
        at = np.cumsum([0] + [len(x) for x in sets])
        a, b = alike(np.array(sum(sets, [7, 7]), dtype=np.int32), at + 2, 0.8)
        expected = [(i, j) for i in range(n) for j in range(i) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})]
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == expected


def test_texts_that_repeat_a_line_differently_are_near_copies(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(20):
        body, line = ([f"{x}{g}x{rnd.randrange(10**6)}" for _ in range(n)] for x, n in (("b", 300), ("l", 25)))
        rows += [(2 * g, " ".join(body + line)), (2 * g + 1, " ".join(body + 30 * line))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_duplicates(df, Scratch(spark, "t")).where("_kept").collect()) == [2 * g for g in range(20)] == groups(rows)


def test_one_shared_key_is_enough_in_a_large_shard(spark):
    """As few keys as one: pairs that share only the hot shard's key are compared."""
    rnd = random.Random(8)
    rows = []
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(rnd.randint(30, 300))]
        other = [f"x{rnd.randrange(10**6)}" if i == 0 else w for i, w in enumerate(base)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    import docquery.llm.simhash as module

    plain = module.signatures
    try:
        # all texts share the first key, and no two of them another
        def hot(data, off, size, keys):
            *others, whole, value, cut = plain(data, off, size, keys)
            others[-1][:] = np.arange(keys, dtype=np.uint64)[None, :] * whole[:, None]
            return (*others, whole, value, cut)

        module.signatures = hot
        got = near_duplicates(df, Scratch(spark, "t"), shard_size=20)
        assert sorted(r.doc_id for r in got.where("_kept").collect()) == [2 * g for g in range(150)] == groups(rows)
    finally:
        module.signatures = plain
