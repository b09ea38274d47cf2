"""Registered queries: one for each operator of the dialect, with the same query in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.database import Database
from docquery.ids import DbConfig
from docquery.plans.compiler import MISSING
from docquery.queries_documents import DOCUMENTS
from docquery.types import MIXED_TYPE

#: Tables and their id columns.
TABLES = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}


@dataclass
class Spec:
    sql: str
    oracle: str
    args: object = MISSING
    rounded: list[str] = field(default_factory=list)


def open_tables(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    for name, key in TABLES.items():
        db.register_parquet(name, f"{sf_dir}/{name}.parquet", DbConfig.none(key))
    return db


FLAGSHIP = """
SELECT n.n_name AS nation, o.o_orderpriority AS priority,
       COUNT(DISTINCT o.o_orderkey) AS orders, SUM(l.l_quantity) AS qty
FROM customer c
JOIN orders o   ON o.o_custkey = c.c_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN nation n   ON n.n_nationkey = c.c_nationkey
WHERE n.n_name IN ('NATION_1', 'NATION_2') OR n.n_nationkey > 20
GROUP BY n.n_name, o.o_orderpriority
HAVING SUM(l.l_quantity) >= 1
ORDER BY nation ASC, qty DESC, priority ASC LIMIT 10
"""

LEFT = "FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 150000"


def same(sql: str, **kw) -> Spec:
    """The text is ANSI SQL as it stands."""
    return Spec(sql, sql, **kw)


SPECS: dict[str, Spec] = {
    "flagship": same(FLAGSHIP),
    "scan_project": same("SELECT o_orderkey, o_totalprice AS price, 1 AS one, 'x' AS tag, TRUE AS yes FROM orders"),
    "literals_in_select": Spec("SELECT n_nationkey, 'a', 2.5, NULL AS nothing FROM nation", "SELECT n_nationkey, 'a' AS _lit, 2.5::DOUBLE AS _lit_1, CAST(NULL AS VARCHAR) AS nothing FROM nation"),
    "select_star": same("SELECT * FROM supplier"),
    "select_star_join": Spec("SELECT * FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", 'SELECT a.n_nationkey AS n_nationkey, a.n_name AS n_name, a.n_regionkey AS n_regionkey, b.n_nationkey AS "b.n_nationkey", b.n_name AS "b.n_name", b.n_regionkey AS "b.n_regionkey" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey'),
    "select_table_star": same("SELECT c.* FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 2"),
    "filter_compare_num": same("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_tax <> 0.02 AND l_linenumber <= 3 AND l_extendedprice > 1000"),
    "filter_not_equal": Spec("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_string_eq": same("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_string_lt_unknown": Spec("SELECT c_custkey FROM customer WHERE c_name < 'Customer#5' OR c_custkey = 1", "SELECT c_custkey FROM customer WHERE c_custkey = 1"),
    "filter_or_and": same("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'F' AND o_totalprice > 200000"),
    "filter_parentheses": same("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderstatus = 'F') AND (o_totalprice > 200000 OR o_custkey < 20)"),
    "filter_in": same("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_not_in": same("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (1, 2, 3, 4, 5)"),
    "filter_in_columns": same("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (l_linenumber, l_partkey)"),
    "not_in_null_lhs": Spec(f"SELECT c.c_custkey AS k, o.o_orderkey AS o {LEFT} WHERE o.o_orderpriority NOT IN ('1-URGENT', '5-LOW')", f"SELECT c.c_custkey AS k, o.o_orderkey AS o {LEFT} WHERE o.o_orderpriority IS NULL OR o.o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
    "in_list_with_null": Spec("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, NULL) OR n_nationkey IN (3, NULL)", "SELECT n_nationkey FROM nation WHERE n_nationkey = 3"),
    "like_ci": Spec("SELECT p_partkey FROM part WHERE p_name LIKE '%A_1%' OR p_type LIKE 'eco%'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%A_1%' OR p_type ILIKE 'eco%'"),
    "not_like_ci": Spec("SELECT c_custkey FROM customer WHERE c_name NOT LIKE '%1'", "SELECT c_custkey FROM customer WHERE c_name NOT ILIKE '%1'"),
    "like_escape": Spec(r"SELECT n_name FROM nation WHERE n_name LIKE 'nation\_1%'", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation~_1%' ESCAPE '~'"),
    "like_column_pattern": Spec("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a, nation b WHERE a.n_name LIKE b.n_name", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a, nation b WHERE a.n_name ILIKE b.n_name"),
    "is_null_after_left_join": same(f"SELECT c.c_custkey AS k {LEFT} WHERE o.o_orderkey IS NULL"),
    "is_not_null": same(f"SELECT c.c_custkey AS k, o.o_orderkey AS o {LEFT} WHERE o.o_orderkey IS NOT NULL"),
    "boolean_literal_compare": same("SELECT n_nationkey FROM nation WHERE TRUE = TRUE AND n_regionkey = 1"),
    "join_inner_equi": same("SELECT o.o_orderkey AS k, c.c_name AS name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
    "join_inner_theta": same("SELECT s.s_suppkey AS s, r.r_regionkey AS r FROM supplier s INNER JOIN region r ON s.s_nationkey > r.r_regionkey AND s.s_acctbal > 0"),
    "join_left": same(f"SELECT c.c_custkey AS k, o.o_orderkey AS o, o.o_totalprice AS p {LEFT}"),
    "join_right": same("SELECT o.o_orderkey AS o, c.c_custkey AS k FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000"),
    "join_full": same("SELECT a.s_suppkey AS s, b.c_custkey AS c FROM supplier a FULL JOIN customer b ON a.s_suppkey = b.c_custkey AND b.c_acctbal > 0"),
    "cross_join_comma": same("SELECT n.n_name AS n, r.r_name AS r FROM nation n, region r"),
    "cross_join_where": same("SELECT n.n_name AS n, r.r_name AS r FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey"),
    "comma_then_join": same("SELECT n.n_name AS n, r.r_name AS r, s.s_suppkey AS s FROM nation n, region r JOIN supplier s ON s.s_nationkey = r.r_regionkey WHERE n.n_nationkey = 3"),
    "self_join_alias": same("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "join_chain": same("SELECT r.r_name AS region, COUNT(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name"),
    "join_subquery": same("SELECT c.c_name AS name, t.n AS n FROM customer c JOIN (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) t ON t.k = c.c_custkey WHERE t.n > 12"),
    "from_subquery": same("SELECT t.seg AS seg, t.n AS n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) AS t WHERE t.n > 1"),
    "nested_subquery": same("SELECT u.k AS k FROM (SELECT t.k AS k FROM (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 100000) t WHERE t.p < 200000) u WHERE u.k > 50"),
    "subquery_limit": same("SELECT t.k AS k, t.p AS p FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) t WHERE t.k > 10"),
    "agg_count_star": same("SELECT COUNT(*) AS n FROM lineitem"),
    "agg_count_col": same(f"SELECT COUNT(o.o_orderkey) AS n, COUNT(*) AS every {LEFT}"),
    "agg_count_distinct": same("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_sum": Spec("SELECT l_returnflag, SUM(l_quantity) AS q, SUM(l_linenumber) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS q, CAST(SUM(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag", rounded=["q"]),
    "agg_sum_distinct": Spec("SELECT l_returnflag, SUM(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_avg": Spec("SELECT o_orderpriority, AVG(o_totalprice) AS p FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 2) AS p FROM orders GROUP BY o_orderpriority", rounded=["p"]),
    "agg_avg_distinct": Spec("SELECT l_linestatus, AVG(DISTINCT l_quantity) AS q FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, ROUND(AVG(DISTINCT l_quantity), 6) AS q FROM lineitem GROUP BY l_linestatus"),
    "agg_minmax_num": same("SELECT c_mktsegment, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer GROUP BY c_mktsegment"),
    "agg_minmax_str": same("SELECT n_regionkey, MIN(n_name) AS lo, MAX(n_name) AS hi FROM nation GROUP BY n_regionkey"),
    "agg_minmax_distinct": same("SELECT MIN(DISTINCT o_orderstatus) AS lo, MAX(DISTINCT o_orderstatus) AS hi FROM orders"),
    "agg_null_group": same("SELECT o.o_orderstatus AS s, COUNT(*) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 GROUP BY o.o_orderstatus"),
    "agg_global_empty": Spec("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS lo FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_orderstatus) AS lo FROM orders WHERE o_orderkey < 0"),
    "agg_grouped_empty": same("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus"),
    "agg_expr_arg": Spec("SELECT n_regionkey, SUM(LENGTH(n_name)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(SUM(LENGTH(n_name)) AS BIGINT) AS n FROM nation GROUP BY n_regionkey"),
    "scalar_over_agg": same("SELECT n_regionkey, LOWER(MIN(n_name)) AS lo, LENGTH(MAX(n_name)) AS n FROM nation GROUP BY n_regionkey"),
    "group_multi": same("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "having": same("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12"),
    "having_hidden_agg": same("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 400000 AND COUNT(*) >= 3"),
    "order_hidden_agg": same("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY SUM(o_totalprice) DESC, o_custkey LIMIT 15"),
    "multi_distinct": same("SELECT COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_partkey) AS p, COUNT(*) AS n FROM lineitem"),
    "agg_name_collision": Spec("SELECT COUNT(o_orderkey), COUNT(*), MAX(o_custkey) AS count_2 FROM orders", "SELECT COUNT(o_orderkey) AS count, COUNT(*) AS count_1, MAX(o_custkey) AS count_2 FROM orders"),
    "order_multi_nulls_last": Spec(f"SELECT c.c_custkey AS k, o.o_orderkey AS o {LEFT} ORDER BY o.o_orderkey DESC, c.c_custkey LIMIT 40", f"SELECT c.c_custkey AS k, o.o_orderkey AS o {LEFT} ORDER BY o.o_orderkey DESC NULLS LAST, c.c_custkey LIMIT 40"),
    "order_nulls_last_asc": Spec(f"SELECT c.c_custkey AS k, o.o_orderkey AS o {LEFT} ORDER BY o.o_orderkey, c.c_custkey OFFSET 10", f"SELECT c.c_custkey AS k, o.o_orderkey AS o {LEFT} ORDER BY o.o_orderkey NULLS LAST, c.c_custkey OFFSET 10"),
    "order_position": same("SELECT s_name, s_acctbal FROM supplier ORDER BY 2 DESC, 1 LIMIT 7"),
    "order_alias": same("SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier ORDER BY bal, k LIMIT 7"),
    "order_hidden_col": same("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 9"),
    "order_expr": same("SELECT n_nationkey FROM nation ORDER BY LENGTH(n_name) DESC, UPPER(n_name) LIMIT 5"),
    "limit_offset": same("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25"),
    "offset_limit": Spec("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 LIMIT 3", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 5"),
    "negative_limit": Spec("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET -3", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4"),
    "fn_upper": same("SELECT c_custkey, UPPER(c_name) AS u FROM customer"),
    "fn_lower": same("SELECT c_custkey, LOWER(c_mktsegment) AS l FROM customer"),
    "fn_trim": same("SELECT p_partkey, TRIM(p_name) AS t FROM part"),
    "fn_length": same("SELECT p_partkey, LENGTH(p_type) AS n FROM part WHERE LENGTH(p_name) > 5"),
    "fn_coalesce": same(f"SELECT c.c_custkey AS k, COALESCE(o.o_orderkey, 0) AS o {LEFT}"),
    "fn_nested": same("SELECT n_nationkey, UPPER(LOWER(TRIM(n_name))) AS n FROM nation"),
    "params_scalar": Spec("SELECT o_orderkey FROM orders WHERE o_custkey = ? AND o_totalprice > ?", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.5", args=[7, 1000.5]),
    "params_single": Spec("SELECT c_custkey FROM customer WHERE c_mktsegment = ?", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", args="BUILDING"),
    "params_in_list": Spec("SELECT o_orderkey FROM orders WHERE o_custkey IN (?)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3)", args=[[1, 2, 3]]),
    "params_empty_list": Spec("SELECT o_orderkey FROM orders WHERE o_custkey IN (?) OR o_orderkey = 1", "SELECT o_orderkey FROM orders WHERE o_orderkey = 1", args=[[]]),
    "params_mixed_in": Spec("SELECT o_orderkey FROM orders WHERE o_custkey IN (1, ?, ?) AND o_orderstatus NOT IN (?)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 4, 5, 6) AND o_orderstatus NOT IN ('F')", args=[[4, 5], 6, ["F"]]),
    "params_like": Spec("SELECT n_name FROM nation WHERE n_name LIKE ?", "SELECT n_name FROM nation WHERE n_name ILIKE '%_2%'", args=["%_2%"]),
    "params_in_subquery": Spec("SELECT t.k AS k, ? AS tag FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > ?) t WHERE t.k < ?", "SELECT t.k AS k, 'x' AS tag FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000) t WHERE t.k < 50", args=["x", 200000, 50]),
    "cross_type_eq_unknown": Spec("SELECT n_nationkey FROM nation WHERE n_name = 1 OR n_nationkey = '2' OR n_nationkey = 3", "SELECT n_nationkey FROM nation WHERE n_nationkey = 3"),
    "null_comparison_unknown": Spec("SELECT n_nationkey FROM nation WHERE n_nationkey = NULL OR n_nationkey = 4", "SELECT n_nationkey FROM nation WHERE n_nationkey = 4"),
    "literal_epsilon": Spec("SELECT n_nationkey FROM nation WHERE 1.0 = 1.0000000001 AND n_regionkey = 0", "SELECT n_nationkey FROM nation WHERE n_regionkey = 0"),
    "timestamp_as_text": Spec("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate LIKE '1995-%'", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders WHERE year(o_orderdate) = 1995"),
    "alias_on_one_column_wildcard": Spec("SELECT t.* AS only FROM (SELECT n_name FROM nation) t", "SELECT n_name AS only FROM nation"),
    "alias_on_wildcard_dropped": Spec("SELECT r.* AS many FROM region r", "SELECT * FROM region"),
    "join_empty_side": same("SELECT c.c_custkey AS k, e.o AS o, e.p AS p FROM customer c LEFT JOIN (SELECT o_orderkey AS o, o_custkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey < 0) e ON e.k = c.c_custkey"),
    "join_empty_full": same("SELECT e.o AS o, r.r_name AS r FROM (SELECT o_orderkey AS o FROM orders WHERE o_orderkey < 0) e FULL JOIN region r ON e.o = r.r_regionkey"),
    "join_full_theta": same("SELECT n.n_nationkey AS n, r.r_regionkey AS r FROM nation n FULL JOIN region r ON n.n_regionkey > r.r_regionkey AND n.n_nationkey > 20"),
    "report_nation_revenue": Spec("SELECT n.n_name AS nation, SUM(l.l_extendedprice) AS revenue, COUNT(DISTINCT c.c_custkey) AS customers FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE l.l_returnflag = 'R' GROUP BY n.n_name HAVING COUNT(*) > 10 ORDER BY nation", "SELECT n.n_name AS nation, ROUND(SUM(l.l_extendedprice), 2) AS revenue, COUNT(DISTINCT c.c_custkey) AS customers FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE l.l_returnflag = 'R' GROUP BY n.n_name HAVING COUNT(*) > 10", rounded=["revenue"]),
    "report_event_types": Spec("SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, AVG(value) AS v FROM events GROUP BY event_type ORDER BY n DESC", "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, ROUND(AVG(value), 4) AS v FROM events GROUP BY event_type", rounded=["v"]),
}

DIGITS = {"v": 4}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = SPECS[name]
        df = open_tables(spark, sf_dir).query(s.sql, s.args)
        if name == "agg_avg_distinct":
            df = df.withColumn("q", F.round("q", 6))
        return df.withColumns({c: F.round(c, DIGITS.get(c, 2)) for c in s.rounded}) if s.rounded else df

    return run


def _linked(spark: SparkSession, sf_dir: str) -> Database:
    db = open_tables(spark, sf_dir)
    for a, col, b, key in (("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("nation", "n_regionkey", "region", "r_regionkey")):
        db.create_reference(a, col, b, key)
    return db


def expand_n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its customer."""
    df = _linked(spark, sf_dir).expand_df("orders", "customer")
    return df.select("o_orderkey", F.size("customer").cast("long").alias("n"), F.col("customer")[0]["c_name"].alias("name"))


def expand_1n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with its orders."""
    df = _linked(spark, sf_dir).expand_df("customer", "orders")
    return df.select("c_custkey", F.size("orders").cast("long").alias("n"))


def expand_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region with its nations and their customers."""
    df = _linked(spark, sf_dir).expand_df("region", "nation.customer")
    return df.select("r_name", F.size("nation").cast("long").alias("nations"), F.aggregate("nation", F.lit(0), lambda a, x: a + F.size(x["customer"])).cast("long").alias("customers"))


def mixed_column_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of values of several primitives, made of those of each event: sorted by rank, compared only with its like."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    turn, none = F.pmod("event_id", F.lit(5)), F.lit(None)
    tagged = lambda rank, b=none, n=none, s=none: F.struct(F.lit(rank).alias("tag"), b.alias("b"), n.alias("n"), s.alias("s")).cast(MIXED_TYPE)
    value = F.when(turn == 0, tagged(1, n=F.col("user_id"))).when(turn == 1, tagged(2, s=F.col("event_type"))).when(turn == 2, tagged(0, b=F.col("value") > 20)).when(turn == 3, tagged(1, n=F.col("value")))
    db = Database(spark, DbConfig.none("event_id"))
    db.register_df("mixed", events.select("event_id", value.alias("v")))
    return db.query("SELECT event_id FROM mixed WHERE v > 20 OR v = 'click' OR v IS NULL OR v IN (TRUE, 'view') ORDER BY v DESC, event_id")


def schema_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of the events, as their collection infers it."""
    fields = open_tables(spark, sf_dir).get("events").schema().fields
    return spark.createDataFrame([(k, v.ty.value, v.nullable) for k, v in fields.items()], "field string, type string, nullable boolean")


def document_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents changed through the API over a registered table, then queried."""
    db = open_tables(spark, sf_dir)
    nation = db.get("nation")
    nation.update_partial(3, {"n_name": "RENAMED"})
    nation.delete(4)
    nation.add({"n_nationkey": 99, "n_name": "NEW", "n_regionkey": 1})
    return db.query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey > 2")


OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "expand_n1": (expand_n1, "SELECT o_orderkey, CAST(count(c_custkey) AS BIGINT) AS n, min(c_name) AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_orderkey"),
    "expand_1n": (expand_1n, "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "expand_chain": (expand_chain, "SELECT r_name, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS nations, CAST(count(c_custkey) AS BIGINT) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name"),
    "mixed_column_sort": (mixed_column_sort, "SELECT event_id FROM events WHERE CASE event_id % 5 WHEN 0 THEN user_id > 20 WHEN 1 THEN event_type IN ('click', 'view') WHEN 4 THEN TRUE ELSE value > 20 END ORDER BY event_id"),
    "schema_infer": (schema_infer, "SELECT column_name AS field, CASE column_type WHEN 'BIGINT' THEN 'Int' WHEN 'DOUBLE' THEN 'Float' ELSE 'String' END AS type, \"null\" = 'YES' AS nullable FROM (DESCRIBE SELECT * FROM events)"),
    "document_api": (document_api, "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey > 2 AND n_nationkey <> 4 UNION ALL SELECT 99, 'NEW', 1"),
}


OTHER |= DOCUMENTS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in SPECS} | {name: f for name, (f, _) in OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s.oracle for name, s in SPECS.items()} | {name: sql for name, (_, sql) in OTHER.items() if sql}
