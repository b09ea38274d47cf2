"""Registered queries of the document API, of errors and of what SQL text alone does not show.

Documents are made from whole tables that stay small at every scale (region,
nation); everything else runs over registered tables.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.database import Database
from docquery.errors import DocQueryError
from docquery.functions.registry import Aggregate
from docquery.ids import DbConfig
from docquery.operators.semantics import Typed
from docquery.sources.tables import read_parquet
from docquery.types import FLOAT, MIXED_TYPE, STRING

Query = Callable[[SparkSession, str], DataFrame]


def _rows(spark: SparkSession, sf_dir: str, name: str) -> list[dict]:
    """A small table as documents."""
    df = read_parquet(spark, f"{sf_dir}/{name}.parquet")
    return [r.asDict() for r in df.orderBy(df.columns[0]).collect()]


def _nations(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark, DbConfig.none("n_nationkey"))
    db.create("nation").add_batch(_rows(spark, sf_dir, "nation"))
    return db


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _error(run: Callable[[], object]) -> str:
    """The name of the error that a call ends with, or "none"."""
    try:
        run()
    except DocQueryError as e:
        return type(e).__name__
    return "none"


# sources and sinks


def json_value_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _nations(spark, sf_dir)
    b = Database(spark, DbConfig.none("n_nationkey"))
    b.load_from_json({name.upper(): rows for name, rows in a.write_to_json().items()})
    return b.query("SELECT n_nationkey, n_name, n_regionkey FROM nation")


def json_file_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir), Database(spark, DbConfig.none("n_nationkey"))
    with tempfile.TemporaryDirectory() as folder:
        a.write_to_file(Path(folder) / "db.json")
        b.load_from_file(Path(folder) / "db.json")
    return b.query("SELECT n_nationkey, n_name, n_regionkey FROM nation")


def json_value_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading replaces what the collection held."""
    c = Database(spark, DbConfig.none("r_regionkey"))
    regions = c.create("region")
    regions.add({"r_regionkey": 99, "r_name": "GONE"})
    regions.load_from_json(_rows(spark, sf_dir, "region"))
    return c.query("SELECT r_regionkey, r_name FROM region")


def json_file_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        db.get("nation").write_to_file(Path(folder) / "nation.json")
        db.get("nation").load_from_file(Path(folder) / "nation.json")
    return db.query("SELECT n_nationkey, n_name, n_regionkey FROM nation")


SCHEMAS = {"people": {"_id": "Id", "name": "String!", "age": "Int", "rate": "Float"}, "tags": {"code": "None:String", "people_id": "Int!", "on": "Bool!", "more": "Object", "all": "Array!"}}


def _fields(spark: SparkSession, db: Database) -> DataFrame:
    return _table(spark, [(n, k, v.ty.value, v.nullable) for n in db.list_collections() for k, v in db.get(n).schema().fields.items()], "collection string, field string, type string, nullable boolean")


def compact_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.load_schemas_from_json(SCHEMAS)
    return _fields(spark, db)


def compact_schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each collection, which is named by the file."""
    import json

    db = Database(spark)
    with tempfile.TemporaryDirectory() as folder:
        for name, schema in SCHEMAS.items():
            path = Path(folder) / f"{name}.json"
            path.write_text(json.dumps(schema), encoding="utf-8")
            db.load_collection_schema_from_file(path)
    return _fields(spark, db)


# projections, predicates, functions


def missing_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, DbConfig.none("n_nationkey"))
    db.create("nation").add_batch([{k: v for k, v in r.items() if k != "n_name" or r["n_nationkey"] % 3} for r in _rows(spark, sf_dir, "nation")])
    return db.query("SELECT n_nationkey, n_name FROM nation WHERE n_name IS NULL OR n_regionkey = 1")


def _flags(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    db.register_df("flags", customers.select("c_custkey", (F.col("c_acctbal") > 0).alias("rich"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") < 10).alias("near")))
    return db


def boolean_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans are equal or not, and have no order."""
    return _flags(spark, sf_dir).query("SELECT c_custkey FROM flags WHERE rich = TRUE AND near <> rich OR near < rich OR near = 1")


def boolean_column_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).query("SELECT c_custkey, near FROM flags WHERE near IN (FALSE, 'x', 0)")


def trim_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    db.register_df("padded", nations.select("n_nationkey", F.concat(F.lit(" \t "), "n_name", F.lit(" x​　\n ")).alias("name")))
    return db.query("SELECT n_nationkey, TRIM(name) AS name, LENGTH(TRIM(name)) AS n FROM padded")


def group_key_named_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.register_df("t", spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("sum"), F.col("o_orderkey").alias("count")), DbConfig.none("count"))
    return db.query("SELECT sum, SUM(count), COUNT(*) FROM t GROUP BY sum")


def avg_distinct_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose sum no long holds."""
    db = Database(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    db.register_df("t", orders.select("o_orderkey", "o_orderpriority", (F.lit(9 * 10**18) + F.col("o_custkey")).alias("big")))
    out = db.query("SELECT o_orderpriority AS p, AVG(DISTINCT big) AS a, AVG(big) AS b FROM t GROUP BY o_orderpriority")
    return out.select("p", F.round(F.col("a") / 1e18, 6).alias("a"), F.round(F.col("b") / 1e18, 6).alias("b"))


def like_pattern_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of a column, with wildcards, escapes and signs that regular expressions use."""
    db = Database(spark)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_name", F.lit(".(x)")).alias("name"))
    pattern = F.element_at(F.array(*map(F.lit, ("%1_(X)", "PART%", "%.(x)", "%\\_%", "%+%", "%#_%.(_)"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    db.register_df("p", parts.withColumn("pattern", F.when(F.col("p_partkey") % 50 != 0, pattern)))
    return db.query("SELECT p_partkey FROM p WHERE name LIKE pattern")


def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.register_parquet("customer", f"{sf_dir}/customer.parquet", DbConfig.none("c_custkey"))
    db.functions.register_scalar("Initial", lambda args, strict: Typed(F.substring(args[0].col, 1, 1), STRING))
    db.functions.register_aggregate("spread", lambda kind: FLOAT, lambda x, distinct: (F.max(x) - F.min(x)).cast("double"))
    assert isinstance(db.functions.aggregates["spread"], Aggregate)
    return db.query("SELECT c_mktsegment, INITIAL(MIN(c_mktsegment)) AS first, SPREAD(c_custkey) AS spread FROM customer GROUP BY c_mktsegment")


def sorted_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.register_parquet("supplier", f"{sf_dir}/supplier.parquet", DbConfig.none("s_suppkey"))
    return db.query_json("SELECT s_suppkey AS z, s_name AS name, s_nationkey AS A FROM supplier")


def mixed_event_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of several primitives over all events: compared with its like, sorted by rank."""
    db = Database(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 4
    mixed = F.when(k == 0, F.struct(F.lit(1).alias("tag"), F.lit(None).cast("boolean").alias("b"), F.col("value").cast("double").alias("n"), F.lit(None).cast("string").alias("s")))
    mixed = mixed.when(k == 1, F.struct(F.lit(2).alias("tag"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("double").alias("n"), F.col("event_type").alias("s")))
    mixed = mixed.when(k == 2, F.struct(F.lit(0).alias("tag"), (F.col("user_id") % 2 == 0).alias("b"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("string").alias("s")))
    db.register_df("events", events.select("event_id", mixed.cast(MIXED_TYPE).alias("v")))
    return db.query("SELECT event_id FROM events WHERE v > 5 OR v = 'click' OR v IS NULL OR v IN (TRUE, 'view') ORDER BY v DESC, event_id LIMIT 500")


# errors


REJECTED: dict[str, list[tuple[str, str]]] = {
    "reject_group_by_expression": [("SELECT COUNT(*) FROM nation GROUP BY LENGTH(n_name)", "ParseError"), ("SELECT COUNT(*) FROM nation GROUP BY 1", "ParseError")],
    "reject_order_by_outside_group": [("SELECT n_regionkey FROM nation GROUP BY n_regionkey ORDER BY n_name", "Other")],
    "reject_correlation": [("SELECT t.k FROM nation n JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey = n.n_regionkey) t ON t.k = 1", "UnknownCollection")],
    "reject_unknown_names": [("SELECT n_name FROM nowhere", "UnknownCollection"), ("SELECT nothing FROM nation", "UnknownColumn"), ("SELECT n_name FROM nation a, nation b", "AmbiguousColumn")],
    "reject_functions": [("SELECT REVERSE(n_name) FROM nation", "FunctionNotFound"), ("SELECT UPPER(n_nationkey) FROM nation", "FunctionNotFound"), ("SELECT UPPER(n_name, n_name) FROM nation", "FunctionArgMismatch"), ("SELECT SUM(n_name) FROM nation", "FunctionArgMismatch"), ("SELECT SUM(COUNT(*)) FROM nation", "Other")],
    "reject_syntax": [("SELECT FROM nation", "ParseError"), ("SELECT n_name nation", "ParseError"), ("SELECT n_name FROM nation WHERE", "ParseError"), ("", "ParseError")],
}


def _rejected(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = _open(spark, sf_dir)
        return _table(spark, [(sql, _error(lambda sql=sql: db.query(sql))) for sql, _ in REJECTED[name]], "query string, error string")

    return run


def _open(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("customer", "c_custkey"), ("orders", "o_orderkey")):
        db.register_parquet(name, f"{sf_dir}/{name}.parquet", DbConfig.none(key))
    return db


def reject_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _open(spark, sf_dir)
    sql = "SELECT n_name FROM nation WHERE n_nationkey = ?"
    cases = {"too few": [], "an object": [{"a": 1}], "too large": [1 << 63], "a list outside IN": [[1, 2]], "too many": [1, 2]}
    return _table(spark, [(k, _error(lambda v=v: db.query(sql, v))) for k, v in cases.items()], "arguments string, error string")


def function_of_other_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside SELECT a string function of another type is null, and so no row passes."""
    return _open(spark, sf_dir).query("SELECT n_nationkey FROM nation WHERE UPPER(n_nationkey) = '1' OR LENGTH(n_regionkey) IS NULL AND n_nationkey < 3")


def reject_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nations(spark, sf_dir)
    c = db.get("nation")
    cases = {
        "no object": lambda: c.add([1]), "no id": lambda: c.add({"x": 1}), "a boolean id": lambda: c.add({"n_nationkey": True}), "an id that exists": lambda: c.add({"n_nationkey": 3}),
        "no array": lambda: c.add_batch({"n_nationkey": 99}), "no root array": lambda: c.load_from_json({"x": 1}), "no root object": lambda: db.load_from_json([1]), "no file": lambda: c.load_from_file("/no/such/file"),
        "a bad schema": lambda: db.load_collection_schema_from_json("x", {"id": "Id", "a": "int"}), "no such column": lambda: db.create_reference("nation", "nope", "nation", "n_name"),
    }
    return _table(spark, [(k, _error(v)) for k, v in cases.items()], "what string, error string")


# documents


def get_exists_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a registered table: every tenth order by id, and ids that there are not."""
    db = _open(spark, sf_dir)
    orders = db.get("orders")
    keys = [1, "1", "01", 1.0, -1, "x"]
    n = orders.count()
    return _table(spark, [(repr(k), orders.exists(k), (orders.get(k) or {}).get("o_orderkey"), n) for k in keys], "key string, found boolean, o_orderkey long, n long")


def paginated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a registered table with a document on top put together again."""
    db = _open(spark, sf_dir)
    nation = db.get("nation")
    nation.add({"n_nationkey": -1, "n_name": "NEW", "n_regionkey": 1})
    pages = [(p, d["n_nationkey"], d["n_name"]) for p in range(9) for d in nation.get_paginated(4 * p, 4)]
    assert [d["n_nationkey"] for d in nation.get_all()] == [k for _, k, _ in pages]
    return _table(spark, pages, "page long, n_nationkey long, n_name string")


def update_replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replaced document keeps its id and loses its other fields."""
    db = _open(spark, sf_dir)
    nation = db.get("nation")
    nation.update(2, {"n_name": "ONLY"})
    nation.update("7", {"n_nationkey": 7, "n_regionkey": 4})
    nation.update(1000, {"n_name": "NOBODY"})
    return db.query("SELECT n_nationkey, n_name, n_regionkey FROM nation")


def clear_keeps_the_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, DbConfig.int("id"))
    c = db.create("nation")
    c.add_batch([{"n_name": r["n_name"]} for r in _rows(spark, sf_dir, "nation")])
    gone = c.clear()
    c.add({"more": gone})
    return db.query("SELECT id, n_name, more FROM nation")


def find_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the values of a column: 1 is not 1.0, and absent is nothing."""
    db = _open(spark, sf_dir)
    db.get("nation").add({"n_nationkey": 77, "n_name": "TWO", "n_regionkey": 2})
    found = db.get("nation").find("n_regionkey", [2, 3.0, "4", None])
    return _table(spark, [(d["n_nationkey"], d["n_name"]) for d in found], "n_nationkey long, n_name string")


def batch_of_known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch stops at the first id that exists; what came before it stays."""
    db = _open(spark, sf_dir)
    error = _error(lambda: db.get("nation").add_batch([{"n_nationkey": 100, "n_name": "A"}, {"n_nationkey": 101, "n_name": "B"}, {"n_nationkey": 5, "n_name": "C"}, {"n_nationkey": 102, "n_name": "D"}]))
    return db.query("SELECT n_nationkey, n_name, ? AS error FROM nation", [error])


def database_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _open(spark, sf_dir)
    db.create_with_config("Extra", DbConfig.int("no"))
    dropped = (db.drop_collection("REGION"), db.drop_collection("region"))
    rows = [(n, db.get(n.upper()).get_name(), db.get(n).get_config().id_type.value, db.get(n).get_config().id_key) for n in db.list_collections()]
    rows.append(("dropped", str(dropped), db.get_config().id_type.value, str(db.get("region"))))
    return _table(spark, rows, "name string, found string, ids string, key string")


def id_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made ids follow the largest that a batch brought, and overwrite those that callers give to add."""
    db = Database(spark, DbConfig.int("id"))
    c = db.create("nation")
    for r in _rows(spark, sf_dir, "nation"):
        if r["n_nationkey"] % 5 == 0:
            c.add_batch([{"id": 10 * r["n_nationkey"], "name": r["n_name"]}, {"id": 1, "name": "first"}])
        else:
            c.add({"id": 3, "name": r["n_name"]})
    return db.query("SELECT id, name FROM nation")


def uuid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, DbConfig.uuid("id"))
    db.create("nation").add_batch([{"name": r["n_name"]} for r in _rows(spark, sf_dir, "nation")])
    return db.query("SELECT LENGTH(id) AS n, COUNT(*) AS rows, COUNT(DISTINCT id) AS ids FROM nation GROUP BY id").groupBy("n").agg(F.sum("rows").alias("rows"), F.sum("ids").alias("ids"))


# references


def _referring(spark: SparkSession, sf_dir: str) -> Database:
    """Tables with conventional names of their keys."""
    db = Database(spark)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    db.register_df("regions", read("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    db.register_df("nations", read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region_id"), F.col("n_name").alias("name")))
    db.register_df("customers", read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation_id"), F.col("c_name").alias("name")))
    return db


def infer_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _referring(spark, sf_dir)
    db.infer_reference("nations", "regions")
    db.infer_reference("customers", "nations")
    rows = [(n, r.column, r.ref_collection, r.ref_column, r.is_referrer) for n in db.list_collections() for r in db.get_collection_refs(n)]
    return _table(spark, rows, "collection string, column string, ref_collection string, ref_column string, is_referrer boolean")


def infer_all_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading schemas infers the references between all collections."""
    db = _referring(spark, sf_dir)
    db.load_schemas_from_json({"notes": {"id": "Id", "nation_id": "Int!", "customer_id": "Int"}})
    rows = [(r.collection, r.column, r.ref_collection, r.ref_column) for r in db.references]
    return _table(spark, rows, "collection string, column string, ref_collection string, ref_column string")


def reference_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _referring(spark, sf_dir)
    db.infer_reference("nations", "regions")
    both = [(n, db.schema_with_refs_of(n)) for n in db.list_collections()]
    rows = [(n, len(x.schema.fields), len(x.inbound), len(x.outbound), (db.get_collection_column_ref(n, "region_id") or r).collection if (r := db.get_collection_column_ref(n, "id")) or db.get_collection_column_ref(n, "region_id") else None) for n, x in both]
    return _table(spark, rows, "collection string, fields long, inbound long, outbound long, found string")


def reference_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    names = (("people", "_id"), ("categories", "category_id"), ("audit", "audit_uuid"), ("Orders", "id"), ("s", "k"))
    return _table(spark, [(n, k, db.create_with_config(n, DbConfig.int(k)).get_reference_column_name()) for n, k in names], "name string, key string, column string")


def expand_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region, by the collection's own method, with its nations and their customers."""
    db = _referring(spark, sf_dir)
    db.infer_reference("nations", "regions")
    db.infer_reference("customers", "nations")
    regions = db.get("regions")
    row = regions.expand_row(regions.get(1), ".nations..customers.", db)
    return _table(spark, [(row["name"], n["id"], n["name"], len(n["customers"])) for n in row["nations"]], "region string, nation long, name string, customers long")


def expand_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations with their regions; a row without the column has no array."""
    db = _referring(spark, sf_dir)
    db.infer_reference("nations", "regions")
    rows = db.expand_list("nations", [*db.get("nations").get_all(), {"id": 1000}, {"id": 1001, "region_id": 99}], "regions")
    return _table(spark, [(r["id"], "regions" in r, r["regions"][0]["name"] if r.get("regions") else None) for r in rows], "id long, expanded boolean, region string")


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


NATION = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"
FIELDS = _values(
    [("people", "_id", "Int", False), ("people", "name", "String", False), ("people", "age", "Int", True), ("people", "rate", "Float", True), ("tags", "code", "String", False), ("tags", "people_id", "Int", False), ("tags", "on", "Bool", False), ("tags", "more", "Object", True), ("tags", "all", "Array", False)],
    "collection, field, type, nullable",
)

DOCUMENTS: dict[str, tuple[Query, str]] = {
    "json_value_db": (json_value_db, NATION),
    "json_file_db": (json_file_db, NATION),
    "json_value_collection": (json_value_collection, "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    "json_file_collection": (json_file_collection, NATION),
    "compact_schemas": (compact_schemas, FIELDS),
    "compact_schema_files": (compact_schema_files, FIELDS),
    "missing_field": (missing_field, "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS n_name FROM nation WHERE n_nationkey % 3 = 0 OR n_regionkey = 1"),
    "boolean_columns": (boolean_columns, "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3 AND NOT c_nationkey < 10"),
    "boolean_column_in": (boolean_column_in, "SELECT c_custkey, FALSE AS near FROM customer WHERE c_nationkey <> 3 AND c_nationkey >= 10"),
    "trim_unicode": (trim_unicode, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name || ' x' || chr(8203) AS name, length(n_name)::BIGINT + 3 AS n FROM nation"),
    "group_key_named_sum": (group_key_named_sum, 'SELECT o_custkey::BIGINT AS "sum", CAST(sum(o_orderkey) AS BIGINT) AS sum_1, count(*) AS "count" FROM orders GROUP BY o_custkey'),
    "avg_distinct_large": (avg_distinct_large, "SELECT o_orderpriority AS p, round(avg(DISTINCT o_custkey) / 1e18 + 9, 6) AS a, round(avg(CAST(9000000000000000000 + o_custkey AS DOUBLE)) / 1e18, 6) AS b FROM orders GROUP BY o_orderpriority"),
    "like_pattern_column": (like_pattern_column, "SELECT p_partkey FROM (SELECT p_partkey, p_name || '.(x)' AS name, ['%1_(X)', 'PART%', '%.(x)', '%~_%', '%+%', '%#_%.(_)'][CAST(p_partkey % 6 + 1 AS INTEGER)] AS pattern FROM part WHERE p_partkey % 50 <> 0) WHERE name ILIKE pattern ESCAPE '~'"),
    "registered_functions": (registered_functions, "SELECT c_mktsegment, substr(c_mktsegment, 1, 1) AS first, CAST(max(c_custkey) - min(c_custkey) AS DOUBLE) AS spread FROM customer GROUP BY c_mktsegment"),
    "sorted_json_rows": (sorted_json_rows, """SELECT '{"A":' || s_nationkey || ',"name":"' || s_name || '","z":' || s_suppkey || '}' AS json FROM supplier"""),
    "mixed_event_column": (mixed_event_column, """
SELECT event_id FROM (SELECT event_id, event_id % 4 AS k, value, event_type, user_id % 2 = 0 AS b FROM events)
WHERE k = 0 AND value > 5 OR k = 1 AND event_type IN ('click', 'view') OR k = 2 AND b OR k = 3
ORDER BY CASE k WHEN 1 THEN 0 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END, CASE WHEN k = 1 THEN event_type END DESC, CASE WHEN k = 0 THEN value END DESC, event_id LIMIT 500"""),
    **{name: (_rejected(name), _values(rows, "query, error")) for name, rows in REJECTED.items()},
    "reject_arguments": (reject_arguments, _values([("too few", "InvalidParameterValue"), ("an object", "InvalidParameterValue"), ("too large", "InvalidParameterValue"), ("a list outside IN", "InvalidParameterValue"), ("too many", "InvalidParameterValue")], "arguments, error")),
    "function_of_other_types": (function_of_other_types, "SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_nationkey < 3"),
    "reject_documents": (reject_documents, _values([("no object", "InvalidDocument"), ("no id", "InvalidDocument"), ("a boolean id", "InvalidDocument"), ("an id that exists", "DuplicateId"), ("no array", "InvalidDocument"), ("no root array", "LoadError"), ("no root object", "LoadError"), ("no file", "LoadError"), ("a bad schema", "SchemaError"), ("no such column", "ReferenceError_")], "what, error")),
    "get_exists_count": (get_exists_count, "SELECT k AS key, o_orderkey IS NOT NULL AS found, o_orderkey, (SELECT count(*) FROM orders) AS n FROM (VALUES ('1', 1), ('''1''', 1), ('''01''', NULL), ('1.0', NULL), ('-1', -1), ('''x''', NULL)) t(k, i) LEFT JOIN orders ON o_orderkey = i"),
    "paginated": (paginated, "SELECT (row_number() OVER (ORDER BY f, n_nationkey) - 1) // 4 AS page, n_nationkey, n_name FROM (SELECT 0 AS f, -1::BIGINT AS n_nationkey, 'NEW' AS n_name UNION ALL SELECT 1, n_nationkey, n_name FROM nation)"),
    "update_replaces": (update_replaces, "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey = 2 THEN 'ONLY' WHEN n_nationkey <> 7 THEN n_name END AS n_name, CASE WHEN n_nationkey = 7 THEN 4 WHEN n_nationkey <> 2 THEN n_regionkey END::BIGINT AS n_regionkey FROM nation"),
    "clear_keeps_the_schema": (clear_keeps_the_schema, "SELECT (SELECT count(*) FROM nation) + 1 AS id, NULL::VARCHAR AS n_name, (SELECT count(*) FROM nation) AS more"),
    "find_by_value": (find_by_value, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 77, 'TWO'"),
    "batch_of_known_ids": (batch_of_known_ids, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 'DuplicateId' AS error FROM (SELECT n_nationkey, n_name FROM nation UNION ALL VALUES (100, 'A'), (101, 'B'))"),
    "database_api": (database_api, _values([("customer", "customer", "None", "c_custkey"), ("extra", "extra", "Int", "no"), ("nation", "nation", "None", "n_nationkey"), ("orders", "orders", "None", "o_orderkey"), ("dropped", "(True, False)", "Uuid", "None")], "name, found, ids, key")),
    "id_sequence": (id_sequence, "SELECT CASE WHEN n_nationkey % 5 = 0 THEN 10 * n_nationkey ELSE greatest(10 * (n_nationkey - n_nationkey % 5), CASE WHEN n_nationkey < 5 THEN 1 ELSE 0 END) + n_nationkey % 5 END::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT 1, 'first'"),
    "uuid_ids": (uuid_ids, "SELECT 36::BIGINT AS n, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS ids FROM nation"),
    "infer_references": (infer_references, _values([("nations", "region_id", "regions", "id", False), ("regions", "id", "nations", "region_id", True), ("customers", "nation_id", "nations", "id", False), ("nations", "id", "customers", "nation_id", True)], "collection, \"column\", ref_collection, ref_column, is_referrer")),
    "infer_all_references": (infer_all_references, _values([("nations", "region_id", "regions", "id"), ("customers", "nation_id", "nations", "id"), ("notes", "nation_id", "nations", "id"), ("notes", "customer_id", "customers", "id")], "collection, column, ref_collection, ref_column").replace(", column,", ', "column",')),
    "reference_lookups": (reference_lookups, _values([("customers", 3, 0, 0, None), ("nations", 3, 1, 0, "nations"), ("regions", 2, 0, 1, "regions")], "collection, fields, inbound, outbound, found")),
    "reference_names": (reference_names, _values([("people", "_id", "people_id"), ("categories", "category_id", "categorie_category_id"), ("audit", "audit_uuid", "audit_uuid"), ("Orders", "id", "order_id"), ("s", "k", "_k")], 'name, key, "column"')),
    "expand_row": (expand_row, "SELECT r_name AS region, n_nationkey::BIGINT AS nation, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey = 1"),
    "expand_list": (expand_list, "SELECT n_nationkey::BIGINT AS id, TRUE AS expanded, r_name AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey UNION ALL VALUES (1000, FALSE, NULL), (1001, TRUE, NULL)"),
}
