import pytest

from corrie import ParseError, Unsupported
from corrie.plans import ast
from corrie.plans.parser import parse


def test_names_fold_and_quotes_keep():
    q = parse('select Id, "Name" from "Users" u where u.id >= -3')
    assert [i.expr for i in q.items] == [ast.Col("ID"), ast.Col("Name")]
    assert q.source == ast.Table("Users", "U")
    assert q.where == ast.Op(">=", ast.Col("ID", "U"), ast.Lit(-3))


def test_trees_do_not_depend_on_space_or_case():
    assert parse("SELECT a FROM t WHERE b = 'x'") == parse("select  A\nfrom T -- note\nwhere B='x';")


def test_precedence():
    e = parse("SELECT * FROM t WHERE a = 1 OR b = 2 AND NOT c = 3 + 4 * 5").where
    assert e.op == "OR" and e.right.op == "AND" and isinstance(e.right.right, ast.Not)
    assert e.right.right.arg.right == ast.Op("+", ast.Lit(3), ast.Op("*", ast.Lit(4), ast.Lit(5)))


def test_joins():
    s = parse("SELECT * FROM a LEFT OUTER JOIN b ON a.x = b.x FULL JOIN c USING (x, y) CROSS JOIN d").source
    assert (s.how, s.left.how, s.left.using, s.left.left.how) == ("cross", "full", ("X", "Y"), "left")


def test_create_and_insert():
    assert parse("CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(10) NOT NULL, c BOOLEAN)").columns == (("A", "INTEGER"), ("B", "VARCHAR"), ("C", "BOOLEAN"))
    assert parse("INSERT INTO t VALUES (1, 'it''s', TRUE), (-9223372036854775808)").rows == ((1, "it's", True), (-(1 << 63),))
    assert parse("DROP ALL TABLES") == ast.DropAll()


@pytest.mark.parametrize(
    "sql",
    ["SELECT 1", "SELECT a FROM t, u", "SELECT a FROM t UNION SELECT a FROM u", "SELECT COUNT(*) OVER (PARTITION BY a) FROM t", "SELECT UPPER(a) FROM t", "SELECT a FROM (SELECT a FROM t)", "SELECT a FROM t WHERE a IN (1)", "SELECT a FROM t WHERE a LIKE 'x'", "SELECT a FROM t WHERE a BETWEEN 1 AND 2", "SELECT a FROM t NATURAL JOIN u", "SELECT a FROM t LEFT SEMI JOIN u ON a = b", "WITH x AS (SELECT a FROM t) SELECT a FROM x", "MERGE INTO t", "DROP TABLE t", "ALTER TABLE t ADD a INT", "CREATE TABLE t AS SELECT a FROM u", "CREATE OR REPLACE TABLE t (a INT)", "CREATE TABLE t (a FLOAT)", "CREATE TABLE t (a INT DEFAULT 3)", "INSERT INTO t SELECT a FROM u", "UPDATE t SET a = 1 FROM u", "SELECT a FROM t LIMIT b", "SELECT a FROM t GROUP BY ALL", "SELECT a FROM t; SELECT b FROM t", "SELECT a FROM t QUALIFY a = 1", "SELECT SUM(*) FROM t", "SELECT COUNT(a, b) FROM t", "SELECT CASE WHEN a THEN 1 END FROM t"],
)
def test_left_out_sql_is_refused(sql):
    with pytest.raises(Unsupported):
        parse(sql)


@pytest.mark.parametrize("sql", ["", "SELECT FROM t", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT 1.5 FROM t", "INSERT INTO t VALUES (99999999999999999999)", "SELECT 'open FROM t", "CREATE TABLE t (a INT, a INT)"])
def test_broken_sql(sql):
    with pytest.raises(ParseError):
        parse(sql)
