import public_tokenizers
from tokenizers import Tokenizer

from docquery.llm.common import Scratch
from docquery.llm.tokens import token_counts

CASES = [
    (1, "Hello world, it's 2024!  Two  spaces\n\n\tand tabs   "), (2, None), (3, ""), (4, "a<|endoftext|>b <|endoftext|><|endoftext|> c"), (5, "naïve café 東京 ՘ ₏ x՘y 1₏2 🙂🙂    z"),
    (6, "z" * 20000), (7, "\x00\x0012 \x1c\x85 a'll b've <|endoftext"), (7, "same id"), (7, "same id"), (None, "no id"), (8, "word " * 30000), (9, " " * 1000),
    (10, "-" * 80), (11, "a " + "-" * 80 + " b"), (12, "=" * 300 + "\n" + "-" * 80), (13, "é" * 33 + " " + "é" * 32), (14, "東" * 40),
]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id long, text string, pre_token string, rid int")
    return sorted((tuple(r) for r in token_counts(df, Scratch(spark, "t"), **kw).collect()), key=str)


def test_matches_the_library(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = CASES + [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    expected = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=str)
    assert run(spark, rows) == expected
    assert run(spark, rows, frequent=50) == expected
    assert run(spark, rows, frequent=0) == expected


def test_empty(spark):
    assert run(spark, []) == []
