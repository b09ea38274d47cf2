import hashlib
import re

from docquery.llm.decontam import contamination, digest

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=13):
    wins = []
    for i, t in items:
        w = tokens(t)
        n = min(size, len(w))
        if n:
            wins += [(str(i) if i is not None else "", tuple(w[p : p + n])) for p in range(len(w) - n + 1)]
    out = []
    for d, t in docs:
        w = tokens(t)
        hit, ids = set(), set()
        for i, x in wins:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    ids.add(i)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "h") for x in docs], "doc_id long, text string, hits string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in digest(contamination(d, b, **kw)).collect()), key=str)


def case():
    base = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(base[:20])), (2, "Short Item, here"), (3, "solo"), (10, " ".join(base[:20])), (4, None), (5, "?!"), (None, "two words"), (6, "é ü ñ x1 " * 5), (7, "a a a a a a a a a a a a a a a")]
    docs = [
        (1, "intro " + " ".join(base[2:18]).upper() + " outro"), (2, " ".join(base[:12])), (3, "x short-item HERE y SOLO"), (4, None), (5, ""), (6, "..."),
        (7, "a " * 40), (8, "é ü ñ x1 " * 9), (9, "two, words"), (9, "two, words"), (None, "solo"), (11, " ".join(base[7:30])), (12, "filler " * 5000 + " ".join(base[:20]) + " filler" * 5000),
        (13, " ".join(base[:20]) + " " + " ".join(base[:20])),
    ]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = case()
    expected = brute(docs, items)
    assert run(spark, docs, items) == expected
    assert run(spark, docs, items, block_bytes=30) == expected


def test_empty(spark):
    docs, items = case()
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])
