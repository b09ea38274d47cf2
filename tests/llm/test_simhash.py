import re

import xxhash

from docquery.llm.common import Scratch
from docquery.llm.simhash import simhash_components


def brute(rows, radius=3):
    fps = []
    for _, text in rows:
        w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], fps[i], min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, shard string")
    return sorted(((r.id, r.fp % (1 << 64), r.component) for r in simhash_components(df, Scratch(spark, "t"), **kw).collect()), key=str)


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    base = " ".join(f"w{i}" for i in range(300))
    for k in range(30):
        w = base.split()
        w[k * 9] = f"x{k}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One"), (2003, "one"), (None, "one"), (None, "alone here"), (2004, base.upper()), (2005, "a" * 100000 + " b c d")]
    expected = brute(rows)
    assert run(spark, rows) == expected
    assert run(spark, rows, shard_size=3) == expected


def test_empty(spark):
    assert run(spark, []) == []
