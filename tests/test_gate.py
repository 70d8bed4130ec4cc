import pytest

from hydrostrata.plans import gate


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([("1", "ASIA"), ("2", "EUROPE")], "state_id string, state_name string").createOrReplaceTempView("g_states")
    return spark


@pytest.mark.parametrize("sql, n", [
    ("SELECT * FROM g_states", 2), ("WITH a AS (SELECT state_id FROM g_states) SELECT count(*) FROM a", 1),
    ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT n FROM t", 5),
    ("SELECT s.state_name FROM g_states s WHERE EXISTS (SELECT 1 FROM g_states t WHERE t.state_id = s.state_id) ORDER BY 1", 2),
    ("SELECT state_name, count(*) FROM g_states GROUP BY 1 HAVING count(*) > 0", 2), ("SELECT state_id FROM g_states UNION SELECT 'x;y' LIMIT 2", 2),
    ("SELECT explode(array(1, 2)) AS x", 2), ("SELECT * FROM VALUES (1), (2) t(a)", 2), ("SELECT state_id, row_number() OVER (ORDER BY state_id) FROM g_states", 2),
])
def test_queries_run(views, sql, n):
    result = gate.execute(views, sql)
    assert result.error is None and len(result.rows) == n


@pytest.mark.parametrize("sql", [
    "DROP TABLE g_states", "DELETE FROM g_states", "UPDATE g_states SET state_id = '3'", "INSERT INTO g_states VALUES ('3', 'x')", "ALTER TABLE g_states ADD COLUMNS (x int)",
    "CREATE TABLE t (x int)", "CREATE TEMP VIEW v AS SELECT 1", "PRAGMA table_info(g_states)", "ATTACH 'x' AS y", "VACUUM", "SET spark.sql.ansi.enabled = false", "CACHE TABLE g_states",
    "ADD JAR 'x.jar'", "EXPLAIN SELECT 1", "SELECT 1; SELECT 2", "SHOW TABLES", "DESCRIBE g_states", "MERGE INTO g_states USING g_states s ON true WHEN MATCHED THEN DELETE",
    "SELECT TRANSFORM(state_id) USING 'cat' AS x FROM g_states", "SELECT * FROM g_states WHERE EXISTS (SELECT TRANSFORM(state_id) USING 'cat' AS x FROM g_states)",
    "WITH a AS (SELECT TRANSFORM(state_id) USING 'cat' AS x FROM g_states) SELECT * FROM a", "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
    "SELECT java_method('java.util.UUID', 'randomUUID')", "SELECT * FROM parquet.`/tmp/x`", "SELECT input_file_name() FROM g_states", "FROM g_states INSERT INTO a SELECT * INSERT INTO b SELECT *",
])
def test_all_else_is_refused(views, sql):
    with pytest.raises(gate.RefusedSQL):
        gate.execute(views, sql)


def test_errors_caps_and_timeouts_are_values(views):
    assert "PARSE" in gate.execute(views, "SELEC 1").error
    assert gate.execute(views, "SELECT nothing FROM g_states").error
    capped = gate.execute(views, "SELECT * FROM range(50)", max_rows=10)
    assert len(capped.rows) == 10 and capped.truncated
    slow = gate.execute(views, "SELECT count(*) FROM range(4000000000) WHERE sqrt(id) + sin(id) + cos(id) < -5", timeout_s=1.0)
    assert "timeout" in slow.error
    assert gate.execute(views, "SELECT 1 AS x").rows == [(1,)]


@pytest.mark.parametrize("sql", [
    "SELECT * FROM g_states", "SELECT * FROM g_states WHERE ', g_states AS (' <> ''", "SELECT * FROM g_states WHERE EXISTS (WITH g_states AS (SELECT 1 AS x) SELECT * FROM g_states)",
    "WITH g_states AS (SELECT * FROM g_states) SELECT * FROM g_states", "WITH a AS (SELECT 1 AS x) SELECT * FROM a, default.g_states", "SELECT (SELECT max(state_id) FROM G_STATES) AS m",
    "WITH a AS (SELECT * FROM g_states), g_states AS (SELECT 1 AS x) SELECT * FROM a",
])
def test_tables_beyond_the_list_are_refused(views, sql):
    with pytest.raises(gate.RefusedSQL, match="table"):
        gate.execute(views, sql, tables={"other"})


def test_listed_tables_and_own_names_pass(views):
    assert len(gate.execute(views, "WITH a AS (SELECT * FROM g_states), b AS (SELECT * FROM A) SELECT * FROM b", tables={"G_states"}).rows) == 2
    assert len(gate.execute(views, "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r", tables=set()).rows) == 3


def test_only_built_in_computing_functions(views):
    views.udf.register("g_own", lambda: 1, "int")
    for call in ("g_own()", "raise_error('x')", "session_user()", "version()", "java_method('java.lang.System', 'nanoTime')"):
        with pytest.raises(gate.RefusedSQL, match="function"):
            gate.execute(views, f"SELECT {call}")
    assert gate.execute(views, "SELECT upper('a'), round(1.26, 1), coalesce(NULL, 1), date_add(DATE'2020-01-01', 1), CAST('1' AS int), IF(true, 1, 2), count(*), 'x' || 'y', 5 % 2, from_json('{\"a\":1}', 'a int')").error is None


def test_order_problem_and_repair(views):
    assert gate.is_ordered(views.sql("SELECT * FROM g_states ORDER BY state_id LIMIT 1"))
    assert not gate.is_ordered(views.sql("SELECT * FROM (SELECT * FROM g_states ORDER BY state_id LIMIT 1) t WHERE state_id = '1'"))
    assert gate.problem(gate.QueryResult(["a"], [(None,)])) == "only nulls" and gate.problem(gate.QueryResult(["a"], [])) == "no rows"
    result, tried = gate.repaired(views, "SELECT * FROM g_states WHERE state_name = 'x'", lambda sql, why: sql.replace("'x'", "'ASIA'"))
    assert len(result.rows) == 1 and len(tried) == 2
