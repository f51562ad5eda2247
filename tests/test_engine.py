import json
import threading
import time
import urllib.request

import pytest

from corrie import Engine, PlanError, SqlError, Unsupported
from corrie.errors import CommitConflict
from corrie.sources.store import StoreConfig


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE users (id INT, name VARCHAR)")
    e.execute("INSERT INTO users VALUES (1, 'Alice'), (2, 'Bob'), (3, 'Charlie')")
    return e


def rows(engine, sql):
    return list(engine.execute(sql).rows)


def test_insertion_order_and_limit(engine):
    engine.execute("INSERT INTO users VALUES (4, 'David'), (5, 'Eve')")
    assert rows(engine, "SELECT * FROM users")[0] == (1, "Alice")
    assert rows(engine, "SELECT id FROM users WHERE id > 1 LIMIT 2") == [(2,), (3,)]
    assert rows(engine, "SELECT id FROM users LIMIT 0") == []
    assert rows(engine, "SELECT COUNT(*) FROM users LIMIT 1") == [(5,)]


def test_padding_types_and_arity(engine):
    engine.execute("INSERT INTO users VALUES (9)")
    assert rows(engine, "SELECT name FROM users WHERE id = 9") == [(None,)]
    for bad in ("VALUES (1, 'a', 2)", "VALUES ('a', 'b')", "VALUES (7, 'x'), (1, 2)", "(nope) VALUES (1)"):
        with pytest.raises(SqlError):
            engine.execute(f"INSERT INTO users {bad}")
    assert engine.row_count("USERS") == 4


def test_null_semantics(spark, engine):
    engine.execute("INSERT INTO users VALUES (4, NULL)")
    assert rows(engine, "SELECT id FROM users WHERE name = NULL") == [(4,)]
    assert sorted(rows(engine, "SELECT id FROM users WHERE name != 'Bob'")) == [(1,), (3,), (4,)]
    assert rows(engine, "SELECT a.id FROM users a JOIN users b ON a.name = b.name WHERE a.id = 4") == [(4,)]
    assert rows(engine, "SELECT id FROM users WHERE name < 'B'") == [(1,)]
    ansi = Engine(spark, engine.store.root, null_semantics="ansi")
    assert rows(ansi, "SELECT id FROM users WHERE name = NULL") == []


def test_mixed_types_never_match(engine):
    assert rows(engine, "SELECT id FROM users WHERE name = 1") == []
    assert rows(engine, "SELECT id FROM users WHERE name > 1 OR id = 2") == [(2,)]
    assert len(rows(engine, "SELECT id FROM users WHERE name != 1")) == 3


def test_aggregates(engine):
    engine.execute("CREATE TABLE t (k VARCHAR, v INT, b BOOLEAN)")
    assert rows(engine, "SELECT COUNT(*), SUM(v), AVG(v), MIN(k) FROM t") == [(0, None, None, None)]
    engine.execute("INSERT INTO t VALUES ('A', -5, TRUE), ('A', NULL, FALSE), ('A', -2), (NULL, 7), (NULL, 7)")
    r = engine.execute("SELECT k, COUNT(*), COUNT(v), SUM(v), AVG(v), COUNT(DISTINCT v), MAX(b) FROM t GROUP BY k ORDER BY k")
    assert r.columns == ("K", "COUNT", "COUNT", "SUM", "AVG", "COUNT", "MAX")
    assert r.rows == (("A", 3, 2, -7, -3, 2, True), (None, 2, 2, 14, 7, 1, None))
    assert sorted(rows(engine, "SELECT k FROM t GROUP BY k"), key=str) == [("A",), (None,)]
    for bad in ("SELECT k, COUNT(*) FROM t", "SELECT SUM(k) FROM t", "SELECT COUNT(nope) FROM t", "SELECT *, COUNT(*) FROM t", "SELECT v FROM t GROUP BY k"):
        with pytest.raises(PlanError):
            engine.execute(bad)


def test_joins(engine):
    engine.execute("CREATE TABLE orders (id INT, user_id INT, amount INT)")
    engine.execute("INSERT INTO orders VALUES (1, 1, 100), (2, 1, 200), (3, 9, 150)")
    assert sorted(rows(engine, "SELECT name, amount FROM users u JOIN orders o ON u.id = o.user_id")) == [("Alice", 100), ("Alice", 200)]
    assert len(rows(engine, "SELECT * FROM users u LEFT JOIN orders o ON u.id = o.user_id")) == 4
    assert len(rows(engine, "SELECT * FROM users u RIGHT JOIN orders o ON u.id = o.user_id")) == 3
    assert len(rows(engine, "SELECT * FROM users u FULL JOIN orders o ON u.id = o.user_id")) == 5
    assert len(rows(engine, "SELECT * FROM users CROSS JOIN orders")) == 9
    assert len(rows(engine, "SELECT * FROM users u JOIN orders o ON u.id < o.user_id AND o.amount > 100")) == 3
    using = engine.execute("SELECT * FROM users JOIN orders USING (id) ORDER BY id")
    assert using.columns == ("ID", "NAME", "USER_ID", "AMOUNT") and using.rows[0] == (1, "Alice", 1, 100)
    assert rows(engine, "SELECT users.id FROM users LEFT JOIN orders USING (id) WHERE orders.id = 2") == [(2,)]
    for bad in ("SELECT id FROM users u JOIN orders o ON u.id = o.id", "SELECT x.id FROM users u", "SELECT * FROM users JOIN users ON TRUE"):
        with pytest.raises(PlanError):
            engine.execute(bad)


def test_update_and_delete(engine):
    engine.execute("UPDATE users SET id = id * 10, name = 'x' WHERE id >= 2")
    assert rows(engine, "SELECT * FROM users") == [(1, "Alice"), (20, "x"), (30, "x")]
    engine.execute("DELETE FROM users WHERE nope = 1")
    engine.execute("DELETE FROM users WHERE name = 'x' AND id < 25")
    assert rows(engine, "SELECT id FROM users") == [(1,), (30,)]
    with pytest.raises(PlanError):
        engine.execute("UPDATE users SET nope = 1")
    engine.execute("DELETE FROM users")
    assert rows(engine, "SELECT COUNT(*) FROM users") == [(0,)]
    assert [r[0] for r in engine.read_snapshot("USERS", 1).orderBy("ID").collect()] == [1, 2, 3]


def test_identifiers_and_catalog(engine):
    engine.execute('CREATE TABLE "users" ("id" INT, id INT)')
    engine.execute('INSERT INTO "users" VALUES (1, 2)')
    assert rows(engine, 'SELECT "id", ID FROM "users"') == [(1, 2)]
    assert engine.list_tables() == ["USERS", "users"]
    assert engine.table_schema("USERS") == [("ID", "INTEGER"), ("NAME", "VARCHAR")]
    assert engine.storage_size("USERS") > 0
    with pytest.raises(PlanError):
        engine.execute("CREATE TABLE users (a INT)")
    engine.execute("CREATE TABLE IF NOT EXISTS users (a INT)")
    engine.execute("DROP ALL TABLES")
    assert engine.list_tables() == []


def test_reopen(spark, tmp_path):
    path = f"file://{tmp_path}"
    a = Engine(spark, path)
    a.execute("CREATE TABLE p (id INT, name VARCHAR, price INT)")
    a.execute("INSERT INTO p VALUES (1, 'Apple', 10), (2, 'Banana', 5)")
    a.execute("UPDATE p SET price = 6 WHERE id = 2")
    b = Engine(spark, path)
    assert rows(b, "SELECT name, price FROM p") == [("Apple", 10), ("Banana", 6)]
    b.execute("INSERT INTO p VALUES (3, 'Cherry', 15)")
    assert rows(a, "SELECT COUNT(*) FROM p") == [(3,)]


def test_cache(engine):
    sql = "SELECT name FROM users WHERE id = 1"
    assert engine.execute_with_cache_info(sql)[1] is False
    assert engine.execute_with_cache_info(sql.lower())[:2] == (engine.execute(sql), True)
    engine.execute("INSERT INTO users VALUES (4, 'D')")
    assert engine.execute_with_cache_info(sql)[1] is False


def test_async(engine):
    q = engine.execute_async("SELECT COUNT(*) FROM users")
    while engine.query_progress(q)["status"] == "Running":
        time.sleep(0.05)
    assert engine.query_result(q).rows == ((3,),)
    bad = engine.execute_async("SELECT nope FROM users")
    while engine.query_progress(bad)["status"] == "Running":
        time.sleep(0.05)
    with pytest.raises(SqlError):
        engine.query_result(bad)


def test_cancel_stays_cancelled(engine, spark):
    engine.register("big", spark.range(3_000_000).selectExpr("id AS k"))
    q = engine.execute_async("SELECT COUNT(*) FROM big a JOIN big b ON a.k < b.k")
    time.sleep(1)
    assert engine.cancel(q)
    time.sleep(1)
    assert engine.query_progress(q)["status"] == "Cancelled"
    assert not engine.cancel(q)


def test_read_only_tables(engine, spark):
    engine.register("n", spark.createDataFrame([(1, "2024-05-01")], "id int, day string").selectExpr("id", "CAST(day AS TIMESTAMP_NTZ) AS day"))
    assert rows(engine, "SELECT id FROM n WHERE day >= '2024-01-01'") == [(1,)]
    for bad in ("INSERT INTO n VALUES (1)", "DELETE FROM n", "UPDATE n SET id = 1"):
        with pytest.raises(PlanError):
            engine.execute(bad)


def test_filters_and_columns_reach_the_files(engine):
    plan = engine.sql("SELECT name FROM users WHERE id > 1")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ID), GreaterThan(ID,1)]" in plan
    assert "ReadSchema: struct<ID:bigint,NAME:string>" in plan


def test_null_safe_equality_joins_by_hash(engine):
    plan = engine.sql("SELECT a.id FROM users a JOIN users b ON a.name = b.name")._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in plan or "SortMergeJoin" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_http(engine):
    from corrie.http_api import server

    s = server(engine, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}/api"

    def call(method, path, body=None):
        r = urllib.request.Request(base + path, json.dumps(body).encode() if body else None, method=method)
        try:
            return json.loads(urllib.request.urlopen(r).read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    q = call("POST", "/execute", {"query": "SELECT name FROM users WHERE id = 2"})["query_id"]
    while (p := call("GET", f"/query/{q}/progress")["progress"])["status"] == "Running":
        time.sleep(0.05)
    assert p["tables_scanned"] == [{"table_name": "USERS", "total_rows": 3}] and p["estimated_total_rows"] == 3
    r = call("GET", f"/query/{q}/result")
    assert r["success"] and r["result"]["rows"] == [[{"type": "Varchar", "value": "Bob"}]] and r["from_cache"] is False and r["execution_time_ms"] > 0
    r = call("POST", "/execute", {"query": "DELETE FROM users WHERE id = 1"})
    assert r["success"] and r["result"]["rows"] == []
    assert call("GET", "/table/USERS")["schema"]["stats"]["row_count"] == 2
    assert [(t["name"], t["row_count"], t["has_pending_buffer"]) for t in call("GET", "/tables")["tables"]] == [("USERS", 2, False)]
    assert call("POST", "/execute", {"query": " "}) == {"success": False, "error": "the query is empty"}
    assert "error" in call("POST", "/execute", {"query": "DELETE FROM nope"})
    assert call("POST", "/execute", [1])[0] == 400
    assert call("GET", "/nope")[0] == 404
    assert b"<textarea" in urllib.request.urlopen(base.removesuffix("api")).read()
    s.shutdown()


def test_unsupported(engine):
    with pytest.raises(Unsupported):
        engine.execute("MERGE INTO users USING x ON 1 = 1")
    with pytest.raises(PlanError):
        engine.sql("DELETE FROM users")


def test_two_writers(spark, tmp_path):
    """Of two commits on one snapshot the first stays and the second is refused whole."""
    a, b = Engine(spark, f"file://{tmp_path}"), Engine(spark, f"file://{tmp_path}")
    a.execute("CREATE TABLE t (id INT)")
    b = Engine(spark, f"file://{tmp_path}")
    old = b.store.snapshot("T")
    a.execute("INSERT INTO t VALUES (1), (2)")
    b.store.snapshot = lambda name, version=None: old
    with pytest.raises(CommitConflict):
        b.execute("INSERT INTO t VALUES (3)")
    assert rows(a, "SELECT id FROM t") == [(1,), (2,)]
    done, errors = [], []

    def insert(i):
        try:
            Engine(spark, f"file://{tmp_path}").execute(f"INSERT INTO t VALUES ({i})")
            done.append(i)
        except CommitConflict as e:
            errors.append(e)

    threads = [threading.Thread(target=insert, args=(i,)) for i in range(10, 14)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert done and len(done) + len(errors) == 4
    assert sorted(r[0] for r in rows(a, "SELECT id FROM t")) == sorted([1, 2, *done])


def test_only_files_with_matches_are_rewritten(engine):
    engine.execute("INSERT INTO users VALUES (4, 'David')")
    engine.execute("INSERT INTO users VALUES (5, 'Eve')")
    before = engine.store.snapshot("USERS")
    engine.execute("DELETE FROM users WHERE nope = 1")
    engine.execute("UPDATE users SET name = 'x' WHERE id = 99")
    assert engine.store.snapshot("USERS") == before
    engine.execute("UPDATE users SET name = 'x' WHERE id = 4")
    after = engine.store.snapshot("USERS")
    assert len(set(before.files) - set(after.files)) == 1 and after.rows == 5
    assert rows(engine, "SELECT * FROM users") == [(1, "Alice"), (2, "Bob"), (3, "Charlie"), (4, "x"), (5, "Eve")]
    engine.execute("DELETE FROM users WHERE id > 3")
    assert engine.row_count("USERS") == 3 and rows(engine, "SELECT id FROM users") == [(1,), (2,), (3,)]


def test_large_results_are_refused(spark, engine):
    small = Engine(spark, engine.store.root, max_rows=2)
    with pytest.raises(PlanError, match="LIMIT"):
        small.execute("SELECT * FROM users")
    assert rows(small, "SELECT id FROM users LIMIT 2") == [(1,), (2,)]
    assert small.sql("SELECT * FROM users").count() == 3


def test_no_sort_without_limit(engine):
    plan = engine.sql("SELECT name FROM users")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_constraints_are_named(spark, engine):
    with pytest.warns(UserWarning, match="PRIMARY KEY of ID, the length of NAME, NOT NULL of NAME"):
        engine.execute("CREATE TABLE c (id INT PRIMARY KEY, name VARCHAR(5) NOT NULL)")
    engine.execute("INSERT INTO c VALUES (1), (1, 'longer than five')")
    assert engine.row_count("C") == 2
    with pytest.raises(Unsupported):
        Engine(spark, constraints="refuse").execute("CREATE TABLE c (id INT UNIQUE)")


def test_registered_tables_arent_cached(engine, spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    engine.register("t", spark.read.parquet(path))
    assert rows(engine, "SELECT COUNT(*) FROM t") == [(3,)]
    spark.range(5).write.mode("append").parquet(path)
    engine.execute("CREATE TABLE other (a INT)")
    assert engine.execute_with_cache_info("SELECT COUNT(*) FROM t")[1] is False


def test_progress_counts_rows(engine):
    engine.execute("CREATE TABLE o (user_id INT)")
    engine.execute("INSERT INTO o VALUES (1), (1), (2)")
    q = engine.execute_async("SELECT u.name, COUNT(*) FROM users u JOIN o ON u.id = o.user_id GROUP BY u.name")
    while engine.query_progress(q)["status"] == "Running":
        time.sleep(0.05)
    p = engine.query_progress(q)
    assert p["rows_joined"] == 3 and p["rows_aggregated"] >= 2 and p["rows_processed"] >= 6


def test_store_config(spark):
    engine = Engine(spark, config=StoreConfig(codec="gzip", target_file_bytes=640, estimated_row_bytes=64, write_parallelism=2))
    engine.import_table("n", spark.range(100))
    names = engine.store.snapshot("N").files
    assert len(names) == 10 and all(n.endswith(".gz.parquet") for n in names)
    assert engine.has_pending_buffer_data("N") is False and engine.pending_data_file_count("N") == 0
    assert engine.describe("N") == [{"name": "ID", "data_type": "INTEGER", "ordinal": 0, "index_type": None}]
