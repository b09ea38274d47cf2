"""Semantics of the dialect on small collections."""

import random

import pytest

from docquery import Database, DbConfig
from docquery.errors import AmbiguousColumn, AnalyzerError, FunctionArgMismatch, FunctionNotFound, InvalidLikePattern, InvalidParameterValue, Other, ParseError, UnknownCollection, UnknownColumn

T_ROWS = [dict(id=1, cat="a", amt=10.0), dict(id=2, cat="a", amt=15.0), dict(id=3, cat="b", amt=7.5), dict(id=4, cat="b", amt=None), dict(id=5, cat="a", amt=22.5)]


@pytest.fixture(scope="module")
def db(spark):
    db = Database(spark, DbConfig.none("id"))
    db.create("t").add_batch(T_ROWS)
    db.create("people").add_batch([dict(id=1, name="Ana", age=30), dict(id=2, name="bob", age=25), dict(id=3, name="Çelik", age=30), dict(id=4, name=None, age=None)])
    db.create("orders").add_batch([dict(id=10, person_id=1, total=5.0), dict(id=11, person_id=1, total=7.0), dict(id=12, person_id=9, total=1.0)])
    db.create("flags").add_batch([dict(id=1, vip=True, s="x\ny", o={"k": 1}, l=[1, 2]), dict(id=2, vip=False, s="100%", o=None, l=[]), dict(id=3, vip=None, s="a_b", o={"k": 1}, l=None)])
    c = db.create("empty_table")
    c.add_batch([dict(id=1, grp="g", v=1.0, sum="s")])
    c.clear()
    return db


def rows(db, sql, *args, **kw):
    return db.query_rows(sql, *args, **kw)


def ids(db, where, table="t", *args):
    return sorted(r["id"] for r in rows(db, f"SELECT id FROM {table} WHERE {where}", *args))


def test_canonical_query(db):
    got = rows(db, "SELECT t.cat AS cat, SUM(t.amt) AS total FROM t WHERE t.id > 1 GROUP BY t.cat HAVING SUM(t.amt) > 20 ORDER BY t.cat LIMIT 10")
    assert got == [{"cat": "a", "total": 37.5}]


@pytest.mark.parametrize(("where", "expected"), [
    ("amt IN (7.5)", [3]), ("amt NOT IN (7.5)", [1, 2, 4, 5]), ("amt NOT IN (7.5, NULL)", []), ("amt IN (7.5, NULL)", [3]), ("cat IN ('a', 1)", [1, 2, 5]), ("cat NOT IN ('a', 1)", [3, 4]),
    ("amt IN ()", []), ("amt NOT IN ()", [1, 2, 3, 4, 5]), ("id IN (amt, 4)", [4]),
    ("cat < 'b'", []), ("cat >= 'a' OR id = 1", [1]), ("cat = 1 OR id = '2'", []), ("cat <> 'a'", [3, 4]), ("amt = NULL", []), ("NULL = NULL OR id = 3", [3]),
    ("id = 1 OR id = 2 AND cat = 'b'", [1]), ("(id = 1 OR id = 2) AND cat = 'a'", [1, 2]), ("amt IS NULL", [4]), ("amt IS NOT NULL AND id < 3", [1, 2]),
    ("cat LIKE 'A'", [1, 2, 5]), ("cat NOT LIKE 'a'", [3, 4]), ("1.0 = 1.0000000001 AND id = 1", [1]), ("1 < 2 AND id = 2", [2]), ("'a' LIKE 'A%' AND id = 3", [3]), ("NULL = 1 AND id > 1", []),
    ("id != 1 AND id <= 3", [2, 3]), ("amt > 7.5 AND amt < 22.5", [1, 2]), ("LENGTH(cat) = 1 AND UPPER(cat) = 'B'", [3, 4]), ("LENGTH(id) = 1", []), ("COALESCE(amt, 0.0) = 0", [4]), ("id = +5", [5]), ("id > -1 AND id < 2", [1]),
])
def test_where(db, where, expected):
    assert ids(db, where) == expected


def test_like_details(db):
    assert ids(db, "s LIKE 'x%y'", "flags") == []
    assert ids(db, "s LIKE '100\\%'", "flags") == [2]
    assert ids(db, "s LIKE 'a\\_b'", "flags") == [3]
    assert ids(db, "s LIKE '___'", "flags") == [3]
    assert ids(db, "s LIKE s", "flags") == [1, 2, 3] and ids(db, "s NOT LIKE s", "flags") == []
    assert ids(db, "name LIKE 'çELIK'", "people") == [3]
    with pytest.raises(InvalidLikePattern):
        ids(db, "s LIKE 1", "flags")


def test_booleans_objects_and_arrays(db):
    assert ids(db, "vip = true", "flags") == [1]
    assert ids(db, "vip <> true", "flags") == [2]
    assert ids(db, "vip < true", "flags") == []
    assert ids(db, "o = o", "flags") == []
    assert ids(db, "o IS NULL", "flags") == [2]
    got = rows(db, "SELECT o, COUNT(*) AS n FROM flags GROUP BY o ORDER BY n DESC")
    assert got == [{"o": {"k": 1}, "n": 2}, {"o": None, "n": 1}]
    assert rows(db, "SELECT l FROM flags ORDER BY id LIMIT 2") == [{"l": [1, 2]}, {"l": []}]


def test_joins(db):
    assert rows(db, "SELECT p.id AS p, o.id AS o FROM people p LEFT JOIN orders o ON o.person_id = p.id ORDER BY p, o") == [{"p": 1, "o": 10}, {"p": 1, "o": 11}, {"p": 2, "o": None}, {"p": 3, "o": None}, {"p": 4, "o": None}]
    assert rows(db, "SELECT p.id AS p, o.id AS o FROM people p RIGHT JOIN orders o ON o.person_id = p.id ORDER BY o") == [{"p": 1, "o": 10}, {"p": 1, "o": 11}, {"p": None, "o": 12}]
    assert len(rows(db, "SELECT * FROM people p FULL JOIN orders o ON o.person_id = p.id")) == 6
    assert len(rows(db, "SELECT a.id AS x FROM t a, t b")) == 25
    assert rows(db, "SELECT e.id AS e, p.id AS p FROM people p LEFT JOIN empty_table e ON e.id = p.id ORDER BY p LIMIT 1") == [{"e": None, "p": 1}]
    assert rows(db, "SELECT COUNT(*) AS n FROM people p LEFT JOIN orders o ON o.person_id > p.id AND p.name IN ('Ana', NULL)") == [{"n": 4}]


def test_empty_aggregates(db):
    assert rows(db, "SELECT COUNT(*) AS n, SUM(v) AS s, AVG(v) AS a, MIN(sum) AS m FROM empty_table") == [{"n": 0, "s": None, "a": None, "m": None}]
    assert rows(db, "SELECT grp, COUNT(*) AS n FROM empty_table GROUP BY grp") == []


def test_output_names(db):
    assert list(rows(db, "SELECT *, COUNT(id) AS n FROM t GROUP BY id, cat, amt")[0]) == ["id", "amt", "cat", "n"]
    assert list(rows(db, "SELECT a.id, b.id, UPPER(a.cat), UPPER(b.cat), 1, 2 FROM t a JOIN t b ON a.id = b.id LIMIT 1")[0]) == ["id", "b.id", "upper", "upper_1", "_lit", "_lit_1"]
    assert db.query("SELECT sum, SUM(v), SUM(DISTINCT v) FROM empty_table GROUP BY sum").columns == ["sum", "sum_1", "sum_2"]


def test_order(db):
    assert [r["id"] for r in rows(db, "SELECT id FROM t ORDER BY amt")] == [3, 1, 2, 5, 4]
    assert [r["id"] for r in rows(db, "SELECT id FROM t ORDER BY amt DESC")] == [5, 2, 1, 3, 4]
    assert [r["n"] for r in rows(db, "SELECT name AS n FROM people ORDER BY age DESC, UPPER(name)")] == ["Ana", "Çelik", "bob", None]
    assert [r["cat"] for r in rows(db, "SELECT cat FROM t GROUP BY cat ORDER BY SUM(amt) DESC")] == ["a", "b"]
    assert [r["id"] for r in rows(db, "SELECT id FROM t ORDER BY 1 DESC OFFSET 1 LIMIT 2")] == [4, 3]
    assert rows(db, "SELECT id FROM t ORDER BY id LIMIT -1") == []
    with pytest.raises(Other):
        rows(db, "SELECT id FROM t ORDER BY 2")


def test_parameters(db):
    assert ids(db, "id IN (1, ?) AND cat = ?", "t", [[2, 3], "b"]) == [3]
    assert ids(db, "id = ?", "t", 4) == [4]
    assert ids(db, "id IN (?)", "t", [[]]) == []
    assert ids(db, "amt = ?", "t", [None]) == []
    got = rows(db, "SELECT x.id AS id, ? AS tag FROM (SELECT id FROM t WHERE id > ?) x WHERE x.id < ? ORDER BY id", ["q", 1, 4])
    assert got == [{"id": 2, "tag": "q"}, {"id": 3, "tag": "q"}]
    for bad in ([], [{"a": 1}], [[1]], [1 << 63], [1, 2]):
        with pytest.raises(InvalidParameterValue):
            rows(db, "SELECT id FROM t WHERE id = ?", bad)


@pytest.mark.parametrize(("sql", "error"), [
    ("SELECT x FROM t", UnknownColumn), ("SELECT id FROM nope", UnknownCollection), ("SELECT T.id FROM t", UnknownCollection), ("SELECT ID FROM t", UnknownColumn), ("SELECT id FROM t a JOIN t b ON a.id = b.id", AmbiguousColumn),
    ("SELECT id FROM t, t", Other), ("SELECT foo(id) FROM t", FunctionNotFound), ("SELECT UPPER(id) FROM t", FunctionNotFound), ("SELECT SUM(cat) FROM t", FunctionArgMismatch), ("SELECT id, COUNT(*) FROM t", AnalyzerError),
    ("SELECT id FROM t WHERE SUM(amt) > 1", AnalyzerError), ("SELECT id FROM t HAVING id > 1", AnalyzerError), ("SELECT COUNT(DISTINCT *) FROM t", FunctionArgMismatch), ("SELECT SUM(AVG(amt)) FROM t", AnalyzerError), ("SELECT cat AS c FROM t GROUP BY cat HAVING c = 'a'", UnknownColumn),
    ("SELECT cat FROM t GROUP BY cat ORDER BY amt", AnalyzerError), ("SELECT id FROM t ORDER BY ?", AnalyzerError), ("SELECT COALESCE(id, cat) FROM t", FunctionArgMismatch), ("SELECT MIN(o) FROM flags", FunctionArgMismatch),
])
def test_analysis_errors(db, sql, error):
    with pytest.raises(error):
        db.query(sql, ["x"] if "?" in sql else []) if "?" in sql else db.query(sql)


@pytest.mark.parametrize("sql", ["", "SELECT", "SELECT id", "SELECT id name FROM t", "SELECT id FROM t WHERE", "SELECT id FROM t WHERE id", "SELECT a.b.c FROM t", "SELECT id FROM t ORDER BY , id", "SELECT id FROM (SELECT id FROM t)", "SELECT id FROM t JOIN t b", "SELECT id FROM t LIMIT x", "SELECT id FROM t GROUP BY UPPER(id)", "SELECT id FROM t; ", "SELECT DISTINCT id FROM t", "SELECT id FROM t WHERE id BETWEEN 1 AND 2", "SELECT 'x FROM t"])
def test_parse_errors(db, sql):
    with pytest.raises(ParseError):
        db.query(sql)


def test_case_and_spacing(db):
    assert rows(db, "select id from T where id=1 and cat='a'")[0] == {"id": 1}
    assert rows(db, "SELECT 'it''s' AS a, \"q\" AS b , TRIM(' x ') AS c FROM t LIMIT 1") == [{"a": "it's", "b": "q", "c": "x"}]
    assert rows(db, "SELECT UPPER('ß') AS u, LENGTH('日本') AS n FROM t LIMIT 1") == [{"u": "SS", "n": 2}]


def test_compat_quirks(spark):
    db = Database(spark, DbConfig.none("id"), compat=True)
    db.create("t").add_batch(T_ROWS)
    assert ids(db, "cat NOT LIKE 'a'") == [1, 2, 5]
    assert ids(db, "id = 1 OR id = 2 AND cat = 'b'") == []
    assert rows(db, "SELECT COALESCE(amt, 1.0) AS c FROM t LIMIT 1") == [{"c": None}]
    assert [r["id"] for r in rows(db, "SELECT x.id AS id FROM (SELECT id FROM t WHERE id > ?) x WHERE x.id > ? ORDER BY id", [3])] == [4, 5]


def test_own_functions(spark):
    from pyspark.sql import functions as F

    from docquery.operators.semantics import Typed
    from docquery.types import JsonPrimitive

    db = Database(spark, DbConfig.none("id"))
    db.create("t").add_batch(T_ROWS)
    db.functions.register_scalar("double", lambda args, strict: Typed(args[0].col * 2, args[0].kind))
    db.functions.register_aggregate("spread", lambda k: JsonPrimitive.FLOAT, lambda x, d: F.max(x) - F.min(x))
    assert rows(db, "SELECT SPREAD(amt) AS s, DOUBLE(MAX(id)) AS d FROM t") == [{"s": 15.0, "d": 10}]


def test_random_predicates(db):
    """Random trees against a three-valued evaluator."""
    rnd = random.Random(5)

    def value(e, r):
        return r.get(e) if isinstance(e, str) else e[0]

    def text(e):
        return e if isinstance(e, str) else "NULL" if e[0] is None else repr(e[0])

    def cmp3(op, a, b):
        fam = lambda v: "n" if isinstance(v, (int, float)) else "s" if isinstance(v, str) else None
        if fam(a) is None or fam(a) != fam(b) or (fam(a) == "s" and op not in ("=", "<>")):
            return None
        return {"=": a == b, "<>": a != b, "<": a < b, ">=": a >= b}[op]

    def tree(depth):
        kind = rnd.choice(["cmp", "in", "null", "and", "or"] if depth else ["cmp", "in", "null"])
        x = rnd.choice(["id", "cat", "amt"])
        lit = lambda: (rnd.choice([1, 2, 7.5, 15.0, "a", "b", None]),)
        if kind == "cmp":
            op, y = rnd.choice(["=", "<>", "<", ">="]), rnd.choice([lit(), "id", "amt"])
            return f"{x} {op} {text(y)}", lambda r: cmp3(op, value(x, r), value(y, r))
        if kind == "null":
            neg = rnd.random() < 0.5
            return f"{x} IS {'NOT ' * neg}NULL", lambda r: (r[x] is None) != neg
        if kind == "in":
            items, neg = [lit() for _ in range(rnd.randint(1, 3))], rnd.random() < 0.5

            def member(r):
                hit = True if any(cmp3("=", r[x], i[0]) for i in items) else None if any(i[0] is None for i in items) else False
                return hit if not neg or hit is None else not hit

            return f"{x} {'NOT ' * neg}IN ({', '.join(map(text, items))})", member
        (s1, f1), (s2, f2) = tree(depth - 1), tree(depth - 1)
        if kind == "and":
            return f"({s1} AND {s2})", lambda r: False if f1(r) is False or f2(r) is False else None if f1(r) is None or f2(r) is None else True
        return f"({s1} OR {s2})", lambda r: True if f1(r) or f2(r) else None if f1(r) is None or f2(r) is None else False

    for _ in range(25):
        s, f = tree(3)
        assert ids(db, s) == [r["id"] for r in T_ROWS if f(r) is True], s
