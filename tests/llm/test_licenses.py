import hashlib
import pathlib
import textwrap

import pytest

from docquery.llm.licenses import DIGESTS, TEXTS, canonical, known_digests, license_scan


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "d", 1) for r in rows], "doc_id long, text string, digest string, lines int")
    return sorted((tuple(r) for r in license_scan(df, **kw).collect()), key=str)


def test_variants_of_known_texts(spark):
    mit = TEXTS["MIT"]
    wrapped = mit.replace(" ", "\n", 40).upper()
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit), (2, wrapped), (3, mit.replace('"', "“")), (4, mit + " and more"), (5, None), (6, ""), (7, "?? --"), (8, "Some prose.\nLicenced under the Apache Licence, version 2.0\nCopyright 2019 A B"),
        (8, "Some prose.\nLicenced under the Apache Licence, version 2.0\nCopyright 2019 A B"), (None, TEXTS["ISC"]), (9, "copyright holders"), (10, "x " * 100000), (11, "Licensed under CC BY-NC 4.0.\nlicensed under cc by nc 4.0\nReleased under the MIT License"),
    ]
    got = run(spark, rows)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert all(by[i][0][2] == "MIT" for i in (1, 2, 3)) and by[None][0][2] == "ISC"
    assert by[4][0][2] is None and by[5][0][1:] == (None, None, "", 0) and by[6][0][1] is None and by[7][0][1] is None
    assert [r[3:] for r in by[8]] == [("Apache-2.0-line", 1)] * 2
    assert by[11][0][3:] == ("CC-BY-NC-4.0-line,MIT-line", 3)
    for r in got:
        text = next(t for i, t in rows if i == r[0])
        assert r[1] == (hashlib.sha256(canonical(text).encode()).hexdigest() if text and canonical(text) else None)


@pytest.mark.parametrize("width", [12, 40, 72, 80, 200])
def test_known_texts_in_any_wrap_with_titles_and_statements(spark, width):
    rows, names = [], []
    for name, text in TEXTS.items():
        if name.endswith("-line"):
            continue
        body = "\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n"))
        for k, made in enumerate((body, f"MIT License\n\nCopyright (c) 2020 A. B. Holder\nAll rights reserved.\n\n{body}", f"# © 1999-2003 Someone\n{body}\n", f"Copyright <YEAR> <HOLDER>\n{body}")):
            rows.append((4 * len(names) + k, made))
        names.append(name)
    got = run(spark, rows)
    assert sorted((r[0], r[2]) for r in got) == [(4 * i + k, n) for i, n in enumerate(names) for k in range(4)]


def test_a_statement_and_a_licence_on_one_line(spark):
    rows = [(i, "Copyright (c) 2020 A. B. Holder. " + " ".join(TEXTS[n].split())) for i, n in enumerate(("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib"))]
    rows += [(9, "Copyright holders be liable for 3 things"), (10, "copyright notice and this permission notice")]
    got = run(spark, rows)
    assert {r[0]: r[2] for r in got} == {0: "MIT", 1: "ISC", 2: "BSD-2-Clause", 3: "BSD-3-Clause", 4: "Zlib", 9: None, 10: None}
    assert all(r[1] for r in got)


@pytest.mark.parametrize(("file", "name"), [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_longer_licences_by_their_digest(spark, file, name):
    path = pathlib.Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no published text here")
    text = path.read_text(encoding="utf-8")
    got = run(spark, [(1, text), (2, text.upper()), (3, text + "x"), (4, text.replace("\n", " \r\n"))])
    assert [r[2] for r in sorted(got)] == [name, name, None, name]


def test_every_known_text_has_its_own_digest(spark):
    assert len(known_digests()) == len(TEXTS) + len(DIGESTS) and len(set(DIGESTS.values())) == len(DIGESTS)
    got = run(spark, [(i, t) for i, t in enumerate(TEXTS.values())])
    assert sorted(r[2] for r in got) == sorted(TEXTS)


def test_empty(spark):
    assert run(spark, []) == []
