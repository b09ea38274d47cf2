import bisect
import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from docquery.llm.sketch import containment, edited_sketches, likeness, merge, op8_fracminhash, range_of, sketch


def brute(rows):
    """(id, n_chars, edited text) with the next row by id, then by the text's digest; nulls first."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(t) // 2
        out.append((i, len(t), t[: len(t) - n] + nxt[:n]))
    return sorted(out, key=str)


ROWS = [(1, "a b c d e f g h i j k l"), (5, None), (3, "é🙂ü x y"), (9, ""), (7, "one"), (7, "one"), (7, "two words"), (None, "no id here"), (None, "another"), (20, "word " * 20000), (21, "b c d e f g")]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, sketch string, _part int")
    return edited_sketches(df, **kw)


def test_edited_texts(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for rows, parts in ((ROWS, 4), (ROWS, 1), (ROWS, 50), (docs, 8), (ROWS[:1], 4)):
        got = sorted(((r.id, r.n, r.edited) for r in run(spark, rows, parts=parts).select("id", F.char_length("text").alias("n"), "edited").collect()), key=str)
        assert got == brute(rows)


def test_empty(spark):
    assert run(spark, []).count() == 0


def test_sketch_estimates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 3000").select("text").limit(150)
    got = edited_sketches(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")).select("text", "edited", likeness(F.col("sketch"), F.col("edited_sketch")).alias("like"), containment(F.col("sketch"), F.col("edited_sketch")).alias("part")).collect()

    def shingles(t):
        w = [x for x in re.split(r"[ \t-\r]+", t) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    off = off_part = 0
    for r in got:
        a, b = shingles(r.text), shingles(r.edited)
        off += abs(len(a & b) / len(a | b) - r.like) / len(got)
        off_part += abs(len(a & b) / len(a) - r.part) / len(got)
    assert off < 0.05 and off_part < 0.06


def test_sketch_merges(spark):
    r = spark.sql("select 'a b c d e f g h' as x, 'p q r s t u v w' as y, '' as z").select(
        merge(sketch(F.col("x")), sketch(F.col("y"))).alias("m"), F.array_sort(F.array_union(sketch(F.col("x"), 0), sketch(F.col("y"), 0))).alias("all"), sketch(F.col("z")).alias("none"),
        sketch(F.lit(None).cast("string")).alias("null"), sketch(F.col("x")).alias("x")
    ).first()
    low = [h for h in r["all"] if h >> 61 == 0]
    assert r.m == (low or [min(r["all"])]) and r.none == [] and r.null == [] and len(r.x) >= 1


def plain(text):
    """A sketch, by the library that Spark's hash is defined by: each word's hash is the seed of the next."""
    w = [x for x in re.split(r"[ \t-\r]+", text) if x]
    found = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        found.add(h >> 1)
    low = {h for h in found if h >> 61 == 0}
    return low or ({min(found)} if found else set())


def test_the_query_matches_brute_force(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + [(-i, t) for i, t in ROWS if i is not None and i not in (7, 5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    text = {i: t or "" for i, t in rows}
    order = sorted(text)
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    show = lambda s: "".join(f"{h:016x}" for h in sorted(s))
    got = op8_fracminhash(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    edited = {r[0]: r[2] for r in brute(rows)}
    for r in got:
        a, b, c = plain(text[r.doc_id]), plain(edited[r.doc_id]), plain(text[order[(order.index(r.doc_id) + 1) % len(order)]])
        assert (r.fingerprint, r.edited_fingerprint) == (show(a), show(b)) and (r.near_edited, r.near_next) == (share(a, b), share(a, c))
        assert r.n_chars == len(text[r.doc_id]) and r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest()


def test_ranges_of_many_cuts(spark):
    for n in (0, 1, 16, 17, 50, 101):
        cuts = [3 * i for i in range(n)]
        got = spark.range(320).select("id", range_of(F.col("id"), cuts).alias("r")).collect()
        assert all(r.r == bisect.bisect_right(cuts, r.id) for r in got)
