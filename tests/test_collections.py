"""Documents, ids, schemas, files, references and expansion."""

import json

import pytest

from docquery import Database, DbConfig, JsonPrimitive, SchemaDict
from docquery.collection import reference_column_name
from docquery.errors import DuplicateId, InvalidDocument, LoadError, ReferenceError_, SchemaError
from docquery.types import FLOAT, INT, NULL, STRING


def test_ids(spark):
    db = Database(spark)
    a = db.create_with_config("A", DbConfig.int())
    assert a.add({"id": 77, "x": 1})["id"] == 1 and a.add({"x": 2})["id"] == 2
    a.add_batch([{"id": 10}, {"id": 4}, {"y": 1}])
    assert a.get(11) == {"y": 1, "id": 11} and a.count() == 5
    b = db.create("b")
    assert len(b.add({})["id"]) == 36 and db.get_config() == DbConfig.uuid()
    c = db.create_with_config("c", DbConfig.none("code"))
    c.add({"code": "x"})
    with pytest.raises(DuplicateId):
        c.add({"code": "x"})
    with pytest.raises(InvalidDocument):
        c.add({"code": None})
    with pytest.raises(DuplicateId):
        c.add_batch([{"code": "y"}, {"code": "x"}, {"code": "z"}])
    assert c.exists("y") and not c.exists("z")
    with pytest.raises(InvalidDocument):
        c.add([1])
    assert db.list_collections() == ["a", "b", "c"] and db.get("a") is a
    assert db.create("A") is not a and db.get("a").count() == 0
    assert db.drop_collection("B") and not db.drop_collection("b")


def test_update_and_delete(spark):
    c = Database(spark, DbConfig.int()).create("docs")
    c.add({"a": {"x": 1, "y": [1]}, "b": 1})
    assert c.update_partial(1, {"a": {"y": 2, "z": 3}}) == {"a": {"x": 1, "y": 2, "z": 3}, "b": 1, "id": 1}
    assert c.update("1", {"c": True}) == {"c": True, "id": 1}
    assert c.update(9, {}) is None and c.update_partial(9, {}) is None and c.delete(9) is None
    c.add_batch([{"n": i} for i in range(5)])
    assert [d["n"] for d in c.get_paginated(1, 3)] == [0, 1, 2]
    assert c.delete(1) == {"c": True, "id": 1} and c.count() == 5
    assert c.clear() == 5 and c.add({})["id"] == 7
    assert "n" in c.schema().fields


def test_schema_inference():
    s = SchemaDict.infer_schema_from_object({"b": 1, "a": None})
    assert list(s.fields) == ["a", "b"] and s.get("a").ty is NULL and s.get("a").nullable
    s.merge_schema(SchemaDict.infer_schema_from_object({"a": "x", "b": 1.5, "c": True}))
    assert s.get("a").ty is STRING and s.get("b").ty is FLOAT and not s.get("c").nullable
    s.merge_schema(SchemaDict.infer_schema_from_object({"b": "no"}))
    assert s.get("b").ty is FLOAT and s.get("c").nullable
    assert JsonPrimitive.promote(INT, STRING) is INT


@pytest.mark.parametrize("bad", [{"id": "Id", "k": "Uuid"}, {"id": "Int!", "x": "Null!"}, {"id": "Id", "x": "int"}, {"id": "Id", "x": ""}, {"": "Int"}, {"id": "None:Bool"}, {"id": "Id", "x": 3}, {"id": "Id!"}, [], {"x": "Int"}, {"id": "Int!"}, {"id": "String"}])
def test_bad_compact_schemas(spark, bad):
    with pytest.raises(SchemaError):
        Database(spark).load_collection_schema_from_json("c", bad)


def test_compact_schemas_and_inferred_references(spark, tmp_path):
    db = Database(spark)
    n = db.load_schemas_from_json({"invoices": {"id": "Id", "amount": "Float!"}, "payments": {"payment_uuid": "Uuid", "invoice_id": "Int!", "note": "String"}})
    assert n == 2 and db.get("payments").get_config() == DbConfig.uuid("payment_uuid")
    ref = db.get_collection_column_ref("payments", "invoice_id")
    assert (ref.ref_collection, ref.ref_column) == ("invoices", "id")
    both = db.schema_with_refs_of("invoices")
    assert not both.inbound and both.outbound[0].ref_collection == "payments"
    (tmp_path / "Users.json").write_text('{"id": "None:Int", "name": "String!"}')
    assert db.load_collection_schema_from_file(tmp_path / "Users.json") == "users"
    with pytest.raises(SchemaError):
        db.load_collection_schema_from_json("users", {"id": "Id"})
    assert db.query_rows("SELECT u.id AS id, u.name AS n FROM users u") == []
    with pytest.raises(LoadError):
        db.load_schemas_from_file(tmp_path / "none.json")


def test_files(spark, tmp_path):
    db = Database(spark, DbConfig.none("id"))
    assert db.load_from_json({"P": [{"id": 1, "n": {"a": 1.0}}], "q": []}) == 2
    db.write_to_file(tmp_path / "db.json")
    other = Database(spark, DbConfig.none("id"))
    other.load_from_file(tmp_path / "db.json")
    assert other.write_to_json() == {"p": [{"id": 1, "n": {"a": 1.0}}], "q": []}
    c = other.get("p")
    c.write_to_file(tmp_path / "p.json")
    assert c.load_from_json([{"id": 2}], keep=True) == 1 and c.count() == 2
    assert c.load_from_file(tmp_path / "p.json") == 1 and c.count() == 1
    for bad in ("[1", "{}"):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(LoadError):
            c.load_from_file(tmp_path / "bad.json")
    c.write_json_lines(f"{tmp_path}/lines")
    assert other.register_json("lines", f"{tmp_path}/lines").count() == 1


def test_missing_fields_and_mixed_columns(spark):
    db = Database(spark, DbConfig.none("id"))
    db.create("m").add_batch([{"id": 1, "v": 3}, {"id": 2, "v": "x"}, {"id": 3}, {"id": 4, "v": True}, {"id": 5, "v": 2.5}, {"id": 6, "v": {"a": 1}}])
    assert [r["id"] for r in db.query_rows("SELECT id FROM m ORDER BY v")] == [4, 5, 1, 2, 6, 3]
    assert [r["v"] for r in db.query_rows("SELECT v FROM m ORDER BY v DESC")] == [{"a": 1}, "x", 3, 2.5, True, None]
    assert [r["id"] for r in db.query_rows("SELECT id FROM m WHERE v > 2 OR v = 'x' ORDER BY id")] == [1, 2, 5]
    assert db.query_rows("SELECT COUNT(v) AS n, COUNT(DISTINCT v) AS d FROM m") == [{"n": 5, "d": 5}]


def test_reference_names():
    assert reference_column_name("people", "_id") == "people_id"
    assert reference_column_name("categories", "category_id") == "categorie_category_id"
    assert reference_column_name("audit", "audit_uuid") == "audit_uuid"
    assert reference_column_name("orders", "id") == "order_id"


def test_expansion(spark):
    db = Database(spark, DbConfig.none("id"))
    db.create("orders").add_batch([{"id": 1, "total": 5.0}, {"id": 2, "total": 6.0}, {"id": 3, "total": 1.0}])
    db.create("order_items").add_batch([{"id": 10, "order_id": 1, "product_id": 7}, {"id": 11, "order_id": 1, "product_id": 8}, {"id": 12, "order_id": 2, "product_id": None}, {"id": 13, "order_id": 1.0, "product_id": 7}])
    db.create("products").add_batch([{"id": 7, "name": "a"}, {"id": 8, "name": "b"}])
    db.create_reference("order_items", "order_id", "orders", "id")
    db.create_reference("order_items", "product_id", "products", "id")
    with pytest.raises(ReferenceError_):
        db.create_reference("order_items", "nope", "orders", "id")
    row = db.expand_row("orders", db.get("orders").get(1), ".order_items..products.")
    assert [i["id"] for i in row["order_items"]] == [10, 11] and row["order_items"][0]["products"] == [{"id": 7, "name": "a"}]
    assert db.expand_list("order_items", [{"x": 1}, {"order_id": 2}], "orders") == [{"x": 1}, {"order_id": 2, "orders": [{"id": 2, "total": 6.0}]}]
    with pytest.raises(ReferenceError_):
        db.expand_row("orders", {"id": 1}, "products")


def test_expansion_of_frames(spark):
    db = Database(spark, DbConfig.none("id"))
    db.register_df("authors", spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string"))
    db.register_df("books", spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "id int, author_id int"))
    db.infer_reference("books", "authors")
    got = {r.id: sorted(b.id for b in r.books) for r in db.expand_df("authors", "books").collect()}
    assert got == {1: [1, 2], 2: [3], 3: []}
    got = {r.id: [a.name for a in r.authors] for r in db.expand_df("books", "authors").collect()}
    assert got == {1: ["a"], 2: ["a"], 3: ["b"], 4: []}


def test_registered_table_with_changes(spark):
    db = Database(spark)
    c = db.register_df("n", spark.createDataFrame([(i, f"n{i}") for i in range(5)], "k int, name string"))
    c.update_partial(2, {"name": "two"})
    c.delete(3)
    c.add({"k": 9, "name": "nine", "more": 1})
    assert [(r["k"], r["name"]) for r in db.query_rows("SELECT k, name FROM n ORDER BY k")] == [(0, "n0"), (1, "n1"), (2, "two"), (4, "n4"), (9, "nine")]
    assert c.count() == 5 and c.get(3) is None and c.get(4) == {"k": 4, "name": "n4"}
    assert json.loads(json.dumps(c.get_all()))[0]["name"] == "two"


def test_lookups_over_a_registered_table_are_pruned(spark, tmp_path):
    spark.range(2000).selectExpr("id AS k", "id % 7 AS g", "concat('n', id) AS name").write.parquet(f"{tmp_path}/t")
    c = Database(spark).register_parquet("t", f"{tmp_path}/t", DbConfig.none("k"))
    assert c.get("7") == {"k": 7, "g": 0, "name": "n7"} and c.get("07") is None and c.get(2000) is None and c.get(7.0) is None
    assert "PushedFilters: [In(k" in c.base.where(c._with_keys(["1", "2"]))._jdf.queryExecution().toString()
    with pytest.raises(DuplicateId):
        c.add_batch([{"k": 5000 + i} for i in range(1500)] + [{"k": 5003}])
    assert c.count() == 3500 and len(c.find("g", [3, 4.0, "5"])) == 286 and c.find("nope", [1]) == [] and c.find("k", [5003]) == [{"k": 5003}]


def test_like_patterns_of_a_column(spark):
    db = Database(spark, DbConfig.none("id"))
    cases = [("a%b", "A\\%b", True), ("axb", "a\\%b", False), ("x", "\\x", True), ("a\\", "a\\", True), ("line\nfeed", "line%", False), ("😀z", "_Z", True), ("(a)", "(%)", True), ("É", "é", True), (None, "%", None), ("x", None, None)]
    db.create("c").add_batch([{"id": i, "t": t, "p": p} for i, (t, p, _) in enumerate(cases)])
    assert [r["id"] for r in db.query_rows("SELECT id FROM c WHERE t LIKE p ORDER BY id")] == [i for i, c in enumerate(cases) if c[2]]
    assert [r["id"] for r in db.query_rows("SELECT id FROM c WHERE t NOT LIKE p ORDER BY id")] == [i for i, c in enumerate(cases) if c[2] is False]


def test_json_rows(spark):
    db = Database(spark, DbConfig.none("id"))
    db.create("c").add_batch([{"id": 1, "b": None, "a": "x"}])
    assert [r.json for r in db.query_json("SELECT id, b, a AS A FROM c").collect()] == ['{"A":"x","b":null,"id":1}']


def test_streams(spark, tmp_path):
    from docquery.streaming import register_stream

    spark.range(100).selectExpr("id", "id % 3 AS g").write.parquet(f"{tmp_path}/in")
    db = Database(spark)
    register_stream(db, "events", f"{tmp_path}/in", "id long, g long")
    for sql, mode, want in (("SELECT id FROM events WHERE g = 1 AND id > 50", "append", 16), ("SELECT g, COUNT(*) AS n FROM events GROUP BY g", "complete", 3)):
        name = f"out_{mode}"
        db.query(sql).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        assert spark.table(name).count() == want


def test_mixed_column_sort_and_schema(spark):
    db = Database(spark, DbConfig.none("id"))
    values = [3, "b", True, None, 1.5, "a", False, 2, [1, 2], {"k": 1}, "B"]
    db.create("mixed").add_batch([{"id": i, "v": v} for i, v in enumerate(values)])
    found = db.query("SELECT id FROM mixed WHERE v > 1 OR v = 'a' OR v IS NULL OR v IN (TRUE, 'b') ORDER BY v DESC, id").collect()
    assert [r.id for r in found] == [1, 5, 0, 7, 4, 2, 3]
    c = Database(spark, DbConfig.int("id")).create("docs")
    c.add_batch([{"a": 1, "s": "x"}, {"a": 2.5, "b": True}, {"s": None, "o": {"k": 1}, "l": [1]}])
    assert {k: (v.ty.value, v.nullable) for k, v in c.schema().fields.items()} == {"id": ("Int", False), "a": ("Float", True), "s": ("String", True), "b": ("Bool", True), "l": ("Array", False), "o": ("Object", False)}
