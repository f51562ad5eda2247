"""One query for each operator of the dialect, in the dialect and in DuckDB's SQL, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def tables_of(*names: str) -> Callable[[SparkSession, str], Engine]:
    def make(spark: SparkSession, sf_dir: str) -> Engine:
        engine = Engine(spark)
        for name in names:
            engine.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        return engine

    return make


def select(sql: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tables_of(*names)(spark, sf_dir).sql(sql)


def script(*statements: str, load: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Statements over an engine's own tables; load: tables filled by a SELECT over the driver's tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for name, sql in (load or {}).items():
            outside = tables_of(*(t for t in TABLES if t.upper() in sql.upper().split()))(spark, sf_dir)
            engine.import_table(name, outside.sql(sql))
        for s in statements[:-1]:
            engine.execute(s)
        return engine.sql(statements[-1])

    return run


def calls(*statements: str, then: Callable[[Engine], DataFrame], load: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Statements over an engine's own tables, and what a method of the engine gives after them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for name, sql in (load or {}).items():
            engine.import_table(name, tables_of(*(t for t in TABLES if t.upper() in sql.upper().split()))(spark, sf_dir).sql(sql))
        for s in statements:
            engine.execute(s)
        return then(engine)

    return run


def _value(engine: Engine, n: int) -> DataFrame:
    return engine.spark.createDataFrame([(n,)], "N long")


_FLAGS = ("CREATE TABLE flags (id INT, ok BOOLEAN)", "INSERT INTO flags VALUES (1, TRUE), (2, FALSE), (3, NULL), (4, TRUE)")
_FLAGS_SQL = "(VALUES (1, true), (2, false), (3, NULL), (4, true)) f(id, ok)"
_USERS = ("CREATE TABLE users (id INT, name VARCHAR, age INT)", "INSERT INTO users VALUES (1, 'Alice', 30), (2, 'Bob'), (3, NULL, 25), (4, 'Alice', -5)")
_USERS_SQL = "(VALUES (1, 'Alice', 30), (2, 'Bob', NULL), (3, NULL, 25), (4, 'Alice', -5)) u(id, name, age)"
_NATIONS = {"nations": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"}

#: name: what runs it, DuckDB's SQL
ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    # scans and projections
    "scan_all_region": (select("SELECT * FROM region", "region"), 'SELECT r_regionkey AS "R_REGIONKEY", r_name AS "R_NAME" FROM region'),
    "project_customer": (select("SELECT c_custkey, c_name FROM customer", "customer"), 'SELECT c_custkey AS "C_CUSTKEY", c_name AS "C_NAME" FROM customer'),
    "project_qualified": (select("SELECT n.n_name, n.n_regionkey FROM nation n", "nation"), 'SELECT n_name AS "N.N_NAME", n_regionkey AS "N.N_REGIONKEY" FROM nation'),
    "project_alias": (select('SELECT n_name AS nation, n_regionkey "Key" FROM nation', "nation"), 'SELECT n_name AS "NATION", n_regionkey AS "Key" FROM nation'),
    "project_table_star": (select("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "nation", "region"), 'SELECT n_nationkey AS "N_NATIONKEY", n_name AS "N_NAME", n_regionkey AS "N_REGIONKEY", r_name AS "R.R_NAME" FROM nation JOIN region ON n_regionkey = r_regionkey'),
    "arith_project": (select("SELECT p_partkey, p_size * 2 - 10 AS x, -p_size + 3 AS y FROM part", "part"), 'SELECT p_partkey AS "P_PARTKEY", CAST(p_size * 2 - 10 AS BIGINT) AS "X", CAST(-p_size + 3 AS BIGINT) AS "Y" FROM part'),
    # predicates
    "filter_eq": (select("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'", "lineitem"), """SELECT l_orderkey AS "L_ORDERKEY", l_linenumber AS "L_LINENUMBER" FROM lineitem WHERE l_returnflag = 'R'"""),
    "filter_ne": (select("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'", "orders"), """SELECT o_orderkey AS "O_ORDERKEY" FROM orders WHERE o_orderstatus <> 'F'"""),
    "filter_range": (select("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20", "part"), 'SELECT p_partkey AS "P_PARTKEY", p_size AS "P_SIZE" FROM part WHERE p_size >= 10 AND p_size < 20'),
    "filter_and": (select("SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber > 3 AND l_linenumber <= 6", "lineitem"), """SELECT l_orderkey AS "L_ORDERKEY" FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber > 3 AND l_linenumber <= 6"""),
    "filter_or": (select("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_nationkey < 3 AND c_custkey > 100)", "customer"), """SELECT c_custkey AS "C_CUSTKEY" FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_nationkey < 3 AND c_custkey > 100)"""),
    "filter_not": (select("SELECT n_name FROM nation WHERE NOT (n_regionkey = 1 OR n_regionkey = 2)", "nation"), 'SELECT n_name AS "N_NAME" FROM nation WHERE NOT (n_regionkey = 1 OR n_regionkey = 2)'),
    "filter_mixed_type": (select("SELECT n_name FROM nation WHERE n_name = 5 OR n_name <> 5 AND n_nationkey < 7", "nation"), 'SELECT n_name AS "N_NAME" FROM nation WHERE n_nationkey < 7'),
    "filter_mixed_order": (select("SELECT n_name FROM nation WHERE n_name < 5", "nation"), '''SELECT n_name AS "N_NAME" FROM nation WHERE typeof(n_name) = 'INTEGER' AND TRY_CAST(n_name AS INTEGER) < 5'''),
    "filter_boolean": (script(*_FLAGS, "SELECT id FROM flags WHERE ok"), f'SELECT CAST(id AS BIGINT) AS "ID" FROM {_FLAGS_SQL} WHERE ok'),
    "filter_not_boolean": (script(*_FLAGS, "SELECT id FROM flags WHERE NOT ok OR id = 4"), f'SELECT CAST(id AS BIGINT) AS "ID" FROM {_FLAGS_SQL} WHERE NOT ok OR id = 4'),
    "is_null_filter": (select("SELECT c.c_custkey FROM customer c LEFT JOIN events e ON c.c_custkey = e.user_id WHERE e.event_id IS NULL", "customer", "events"), 'SELECT c_custkey AS "C.C_CUSTKEY" FROM customer c LEFT JOIN events e ON c.c_custkey = e.user_id WHERE e.event_id IS NULL'),
    "null_safe_eq": (script(*_USERS, "SELECT id FROM users WHERE name = NULL OR age <> 30"), f'SELECT CAST(id AS BIGINT) AS "ID" FROM {_USERS_SQL} WHERE name IS NOT DISTINCT FROM NULL OR age IS DISTINCT FROM 30'),
    # order and limit
    "limit_ordered": (select("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders"), 'SELECT o_orderkey AS "O_ORDERKEY", o_totalprice AS "O_TOTALPRICE" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25'),
    "limit_offset": (select("SELECT c_custkey FROM customer ORDER BY 1 LIMIT 10 OFFSET 5", "customer"), 'SELECT c_custkey AS "C_CUSTKEY" FROM customer ORDER BY 1 LIMIT 10 OFFSET 5'),
    "limit_zero": (select("SELECT * FROM nation LIMIT 0", "nation"), 'SELECT n_nationkey AS "N_NATIONKEY", n_name AS "N_NAME", n_regionkey AS "N_REGIONKEY" FROM nation LIMIT 0'),
    "limit_insertion_order": (script(*_USERS, "SELECT id, name FROM users WHERE id > 1 LIMIT 2"), f'SELECT CAST(id AS BIGINT) AS "ID", name AS "NAME" FROM {_USERS_SQL} WHERE id IN (2, 3)'),
    "distinct_rows": (select("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "lineitem"), 'SELECT DISTINCT l_returnflag AS "L_RETURNFLAG", l_linestatus AS "L_LINESTATUS" FROM lineitem'),
    # aggregates
    "count_star": (select("SELECT COUNT(*) FROM lineitem", "lineitem"), 'SELECT count(*) AS "COUNT" FROM lineitem'),
    "count_col": (select("SELECT COUNT(e.event_id) AS n FROM customer c LEFT JOIN events e ON c.c_custkey = e.user_id", "customer", "events"), 'SELECT count(e.event_id) AS "N" FROM customer c LEFT JOIN events e ON c.c_custkey = e.user_id'),
    "count_distinct": (select("SELECT COUNT(DISTINCT l_suppkey) FROM lineitem", "lineitem"), 'SELECT count(DISTINCT l_suppkey) AS "COUNT" FROM lineitem'),
    "sum_int": (select("SELECT SUM(l_linenumber) FROM lineitem", "lineitem"), 'SELECT CAST(sum(l_linenumber) AS BIGINT) AS "SUM" FROM lineitem'),
    "sum_distinct": (select("SELECT SUM(DISTINCT p_size) FROM part", "part"), 'SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS "SUM" FROM part'),
    "avg_int": (select("SELECT AVG(l_partkey) FROM lineitem", "lineitem"), 'SELECT CAST(sum(l_partkey) // count(l_partkey) AS BIGINT) AS "AVG" FROM lineitem'),
    "avg_distinct": (select("SELECT p_brand, AVG(DISTINCT p_size) FROM part GROUP BY p_brand", "part"), 'SELECT p_brand AS "P_BRAND", CAST(sum(DISTINCT p_size) // count(DISTINCT p_size) AS BIGINT) AS "AVG" FROM part GROUP BY 1'),
    "avg_negative": (script(*_USERS, "INSERT INTO users VALUES (5, 'E', -40)", "SELECT AVG(age) AS a FROM users WHERE age < 0"), f'SELECT CAST(trunc(sum(age) / count(age)) AS BIGINT) AS "A" FROM (SELECT age FROM {_USERS_SQL} UNION ALL SELECT -40) WHERE age < 0'),
    "min_max_str": (select("SELECT MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer", "customer"), 'SELECT min(c_name) AS "LO", max(c_name) AS "HI" FROM customer'),
    "min_max_boolean": (script(*_FLAGS, "SELECT MIN(ok) AS lo, MAX(ok) AS hi, COUNT(ok) AS n FROM flags"), f'SELECT min(ok) AS "LO", max(ok) AS "HI", count(ok) AS "N" FROM {_FLAGS_SQL}'),
    "multi_agg": (select("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_suppkey) AS lo, MAX(l_suppkey) AS hi, COUNT(DISTINCT l_partkey) AS d FROM lineitem WHERE l_linestatus = 'O'", "lineitem"), """SELECT count(*) AS "N", CAST(sum(l_linenumber) AS BIGINT) AS "S", min(l_suppkey) AS "LO", max(l_suppkey) AS "HI", count(DISTINCT l_partkey) AS "D" FROM lineitem WHERE l_linestatus = 'O'"""),
    "group_one": (select("SELECT l_returnflag, COUNT(*), SUM(l_linenumber) FROM lineitem WHERE l_linenumber >= 2 GROUP BY l_returnflag", "lineitem"), 'SELECT l_returnflag AS "L_RETURNFLAG", count(*) AS "COUNT", CAST(sum(l_linenumber) AS BIGINT) AS "SUM" FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1'),
    "group_many": (select("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, AVG(l_suppkey) AS a FROM lineitem GROUP BY l_returnflag, l_linestatus", "lineitem"), 'SELECT l_returnflag AS "L_RETURNFLAG", l_linestatus AS "L_LINESTATUS", count(*) AS "N", CAST(sum(l_suppkey) // count(l_suppkey) AS BIGINT) AS "A" FROM lineitem GROUP BY 1, 2'),
    "group_no_agg": (select("SELECT c_mktsegment FROM customer GROUP BY c_mktsegment", "customer"), 'SELECT DISTINCT c_mktsegment AS "C_MKTSEGMENT" FROM customer'),
    "group_null_key": (select("SELECT e.event_type AS t, COUNT(*) AS n FROM customer c LEFT JOIN events e ON c.c_custkey = e.user_id GROUP BY e.event_type", "customer", "events"), 'SELECT e.event_type AS "T", count(*) AS "N" FROM customer c LEFT JOIN events e ON c.c_custkey = e.user_id GROUP BY 1'),
    "group_having_order": (select("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14 ORDER BY n DESC, o_custkey LIMIT 20", "orders"), 'SELECT o_custkey AS "O_CUSTKEY", count(*) AS "N" FROM orders GROUP BY 1 HAVING count(*) > 14 ORDER BY 2 DESC, 1 LIMIT 20'),
    "agg_empty_input": (select("SELECT COUNT(*) AS n, SUM(n_regionkey) AS s, AVG(n_regionkey) AS a, MIN(n_name) AS m FROM nation WHERE n_nationkey < 0", "nation"), 'SELECT count(*) AS "N", CAST(sum(n_regionkey) AS BIGINT) AS "S", CAST(trunc(avg(n_regionkey)) AS BIGINT) AS "A", min(n_name) AS "M" FROM nation WHERE n_nationkey < 0'),
    "agg_then_limit": (select("SELECT COUNT(*) FROM nation LIMIT 1", "nation"), 'SELECT count(*) AS "COUNT" FROM nation'),
    "agg_double": (select("SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", "lineitem"), 'SELECT l_returnflag AS "L_RETURNFLAG", sum(l_quantity) AS "S" FROM lineitem GROUP BY 1'),
    # joins
    "join_inner": (select("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer"), 'SELECT o_orderkey AS "O_ORDERKEY", c_name AS "C_NAME" FROM orders JOIN customer ON o_custkey = c_custkey'),
    "join_inner_multi_key": (select("SELECT a.l_orderkey AS k, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", "lineitem"), 'SELECT a.l_orderkey AS "K", b.l_quantity AS "Q" FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber'),
    "join_three_way": (select("SELECT r_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "customer", "nation", "region"), 'SELECT r_name AS "R_NAME", count(*) AS "N" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1'),
    "join_left": (select("SELECT c_custkey, event_id FROM customer LEFT JOIN events ON c_custkey = user_id", "customer", "events"), 'SELECT c_custkey AS "C_CUSTKEY", event_id AS "EVENT_ID" FROM customer LEFT JOIN events ON c_custkey = user_id'),
    "join_right": (select("SELECT event_id, c_custkey FROM events RIGHT JOIN customer ON c_custkey = user_id", "customer", "events"), 'SELECT event_id AS "EVENT_ID", c_custkey AS "C_CUSTKEY" FROM events RIGHT JOIN customer ON c_custkey = user_id'),
    "join_full": (select("SELECT n_name, s_suppkey FROM nation FULL OUTER JOIN supplier ON n_nationkey = s_suppkey", "nation", "supplier"), 'SELECT n_name AS "N_NAME", s_suppkey AS "S_SUPPKEY" FROM nation FULL OUTER JOIN supplier ON n_nationkey = s_suppkey'),
    "join_cross": (select("SELECT n_name, r_name FROM nation CROSS JOIN region", "nation", "region"), 'SELECT n_name AS "N_NAME", r_name AS "R_NAME" FROM nation CROSS JOIN region'),
    "join_no_condition": (select("SELECT n_name, r_name FROM nation LEFT JOIN region", "nation", "region"), 'SELECT n_name AS "N_NAME", r_name AS "R_NAME" FROM nation CROSS JOIN region'),
    "join_using": (select("SELECT doc_id, toxic, n_chars FROM documents FULL JOIN labels USING (doc_id)", "documents", "labels"), 'SELECT doc_id AS "DOC_ID", toxic AS "TOXIC", n_chars AS "N_CHARS" FROM documents FULL JOIN labels USING (doc_id)'),
    "join_theta": (select("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation"), 'SELECT a.n_nationkey AS "A", b.n_nationkey AS "B" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey'),
    "join_theta_only": (select("SELECT a.n_nationkey AS a, r_regionkey AS b FROM nation a LEFT JOIN region ON a.n_regionkey < r_regionkey", "nation", "region"), 'SELECT n_nationkey AS "A", r_regionkey AS "B" FROM nation LEFT JOIN region ON n_regionkey < r_regionkey'),
    "join_self_alias": (select("SELECT a.c_custkey, b.c_custkey FROM customer a JOIN customer b ON a.c_custkey = b.c_nationkey", "customer"), 'SELECT a.c_custkey AS "A.C_CUSTKEY", b.c_custkey AS "B.C_CUSTKEY" FROM customer a JOIN customer b ON a.c_custkey = b.c_nationkey'),
    "join_left_group": (select("SELECT c.c_mktsegment, COUNT(e.event_id) AS n FROM customer c LEFT JOIN events e ON c.c_custkey = e.user_id GROUP BY c.c_mktsegment", "customer", "events"), 'SELECT c.c_mktsegment AS "C.C_MKTSEGMENT", count(e.event_id) AS "N" FROM customer c LEFT JOIN events e ON c.c_custkey = e.user_id GROUP BY 1'),
    "join_where": (select("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND c_nationkey = 3", "customer", "orders"), """SELECT c_name AS "C_NAME", o_orderkey AS "O_ORDERKEY" FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND c_nationkey = 3"""),
    "null_safe_join": (script(*_USERS, "SELECT a.id AS a, b.id AS b FROM users a JOIN users b ON a.name = b.name"), f'SELECT CAST(a.id AS BIGINT) AS "A", CAST(b.id AS BIGINT) AS "B" FROM (SELECT * FROM {_USERS_SQL}) a JOIN (SELECT * FROM {_USERS_SQL}) b ON a.name IS NOT DISTINCT FROM b.name'),
    "null_safe_using": (script(*_USERS, "SELECT name, COUNT(*) AS n FROM users a FULL JOIN users b USING (name) GROUP BY name"), f'SELECT name AS "NAME", count(*) AS "N" FROM (SELECT a.name FROM (SELECT * FROM {_USERS_SQL}) a JOIN (SELECT * FROM {_USERS_SQL}) b ON a.name IS NOT DISTINCT FROM b.name) GROUP BY 1'),
    # statements that change tables
    "insert_pad": (script(*_USERS, "SELECT * FROM users"), f'SELECT CAST(id AS BIGINT) AS "ID", name AS "NAME", CAST(age AS BIGINT) AS "AGE" FROM {_USERS_SQL}'),
    "insert_columns": (script(*_USERS, "INSERT INTO users (age, id) VALUES (9, 8)", "SELECT * FROM users WHERE id = 8"), f'SELECT CAST(id AS BIGINT) AS "ID", name AS "NAME", CAST(age AS BIGINT) AS "AGE" FROM (SELECT * FROM {_USERS_SQL} UNION ALL SELECT 8, NULL, 9) WHERE id = 8'),
    "update_where": (script("UPDATE nations SET region = region * 10, name = 'far' WHERE region >= 3", "SELECT * FROM nations", load=_NATIONS), """SELECT CAST(n_nationkey AS BIGINT) AS "ID", CASE WHEN n_regionkey >= 3 THEN 'far' ELSE n_name END AS "NAME", CAST(CASE WHEN n_regionkey >= 3 THEN n_regionkey * 10 ELSE n_regionkey END AS BIGINT) AS "REGION" FROM nation"""),
    "update_all": (script("UPDATE nations SET region = 7", "SELECT id, region FROM nations", load=_NATIONS), 'SELECT CAST(n_nationkey AS BIGINT) AS "ID", CAST(7 AS BIGINT) AS "REGION" FROM nation'),
    "delete_where": (script("DELETE FROM nations WHERE region = 1 OR id > 20", "SELECT * FROM nations", load=_NATIONS), 'SELECT CAST(n_nationkey AS BIGINT) AS "ID", n_name AS "NAME", CAST(n_regionkey AS BIGINT) AS "REGION" FROM nation WHERE NOT (n_regionkey = 1 OR n_nationkey > 20)'),
    "delete_unknown_column": (script("DELETE FROM nations WHERE nope = 1", "SELECT COUNT(*) FROM nations", load=_NATIONS), 'SELECT count(*) AS "COUNT" FROM nation'),
    "delete_all": (script("DELETE FROM nations", "SELECT COUNT(*) FROM nations", load=_NATIONS), 'SELECT count(*) AS "COUNT" FROM (SELECT * FROM nation EXCEPT SELECT * FROM nation)'),
    "row_count": (calls("DELETE FROM nations WHERE region = 1", then=lambda e: _value(e, e.row_count("NATIONS")), load=_NATIONS), 'SELECT count(*) AS "N" FROM nation WHERE n_regionkey <> 1'),
    "time_travel": (calls("UPDATE nations SET region = 9", "DELETE FROM nations WHERE id < 5", then=lambda e: e.read_snapshot("NATIONS", 1), load=_NATIONS), 'SELECT CAST(n_nationkey AS BIGINT) AS "ID", n_name AS "NAME", CAST(n_regionkey AS BIGINT) AS "REGION" FROM nation'),
    "drop_all_recreate": (script(*_USERS, "DROP ALL TABLES", *_USERS, "SELECT COUNT(*) FROM users"), f'SELECT count(*) AS "COUNT" FROM {_USERS_SQL}'),
}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLES = {name: sql for name, (_, sql) in ALL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["group_one"](spark, sf_dir)
