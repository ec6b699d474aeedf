import pytest
from pyspark.sql import functions as F

from millrace.operators import corpus as cp, review as rv
from tests.conftest import rows


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def extract(spark, text):
    df = spark.createDataFrame([("f", text)], "file_path string, content string")
    found = cp.extract_statements(df).orderBy("line_number", "statement").collect()
    return [(r.statement, r.line_number, round(r.confidence, 1)) for r in found]


def test_extract_by_blank_lines(spark):
    text = "SELECT * FROM users;\n\n\nINSERT INTO t SELECT 1 FROM s;\n\n\nUPDATE t SET a = 1 WHERE b = 2;"
    got = extract(spark, text)
    assert [g[0] for g in got] == ["SELECT * FROM users;", "INSERT INTO t SELECT 1 FROM s;", "UPDATE t SET a = 1 WHERE b = 2;"]
    assert [g[1] for g in got] == [1, 3, 5]


def test_extract_by_pattern_when_nothing_separates(spark):
    got = extract(spark, "see SELECT a FROM t; and\nSELECT b FROM s WHERE c = 1; end")
    assert {g[0] for g in got} >= {"SELECT a FROM t;", "SELECT b FROM s WHERE c = 1;"}


def test_extract_counts_a_repeated_statement_once(spark):
    got = extract(spark, "SELECT a FROM t;\n---\nselect  a\nfrom t;\n---\nSELECT b FROM t;")
    assert [g[0] for g in got] == ["SELECT a FROM t;", "SELECT b FROM t;"]


def test_extract_nothing(spark):
    assert extract(spark, "no statement") == [] and extract(spark, "") == []


def test_clean_text(spark):
    assert value(spark, cp.clean_text(F.lit("  a\t\n b\u00e9\u2003c\x00d "))) == "a b  c d"


@pytest.mark.parametrize(
    "text,ok",
    [
        ("SELECT a FROM t", True),
        ("select 1", False),
        ("SELECT something here", False),
        ("hello SELECT a FROM t", False),
        ("  WITH x AS (SELECT 1 FROM t) SELECT * FROM x", True),
        ("DROP TABLE t", True),
    ],
)
def test_valid_sql(spark, text, ok):
    assert value(spark, cp.valid_sql(F.lit(text))) is ok


@pytest.mark.parametrize(
    "text,score",
    [
        ("SELECT a, b FROM t WHERE c = 1;", 1.0),
        ("SELECT a FROM t", 0.5),
        ("DELETE t (", 0.2),
        ("SELECT a, b, c FROM t", 0.7),
    ],
)
def test_confidence(spark, text, score):
    assert value(spark, cp.confidence(F.lit(text))) == score


@pytest.mark.parametrize(
    "text,by_functions,by_syntax",
    [
        ("SELECT STRING_AGG(x) FROM t", "postgres", "standard"),
        ("SELECT NVL(a, 0) FROM dual", "oracle", "oracle"),
        ("SELECT GETDATE()", "redshift", "sqlserver"),
        ("SELECT a::int, now() FROM t", "spark", "postgres"),
        ("SELECT 1", "spark", "standard"),
    ],
)
def test_dialect(spark, text, by_functions, by_syntax):
    assert value(spark, cp.dialect_by_functions(F.lit(text))) == by_functions
    assert value(spark, cp.dialect_by_syntax(F.lit(text))) == by_syntax


def test_complexity(spark):
    text = "SELECT CASE WHEN a THEN 1 END, SUM(b) OVER (PARTITION BY c) FROM t JOIN u ON 1=1 WHERE d IN (SELECT e FROM (SELECT f FROM g))"
    assert value(spark, cp.complexity(F.lit(text))) == 1 + 2 + 3 + 2 + 2
    assert value(spark, cp.complexity_by_keywords(F.lit("select a::text, substring(b) from t join u"))) == 3 + 1 + 2


def test_names(spark):
    text = F.lit("SELECT * FROM app_db_eu_42_main.t JOIN s.u ON t.a = u.b JOIN u")
    assert value(spark, cp.tables_of(text)) == ["t", "u"]
    assert set(value(spark, cp.schemas_of(text))) >= {"app_db_eu_42_main", "s"}
    assert value(spark, cp.tenants_of(text)) == ["42"]


def test_lint_and_workspace(spark):
    df = spark.createDataFrame(
        [(1, "SELECT * FROM a JOIN b JOIN c JOIN d JOIN e"), (2, "nothing"), (3, "SELECT x FROM t WHERE a = 'b ORDER BY x")],
        "id int, sql string",
    )
    found = {(r.id, r.rule) for r in cp.findings(df, ["id"], cp.lint_rules("sql")).collect()}
    assert found == {
        (1, "select_star"), (1, "several_joins"), (1, "no_where"), (3, "order_without_limit"), (3, "open_string"),
    }
    files = cp.workspace_files(df, ["id"], "sql")
    assert rows(files, "id", "opportunities") == [(1, 3), (3, 0)]
    assert tuple(cp.workspace_totals(files).first()) == (2, 3, 0, 1, 15)


# --- code review -------------------------------------------------------------------

CODE = '''from pyspark.sql import SparkSession
spark = SparkSession.builder.getOrCreate()
df = spark.read.option("inferSchema", "true").csv("s3://bucket/x")
n = df.count()
def f(a):
    """Documented."""
def g(a):
    return a'''


@pytest.fixture(scope="module")
def code(spark):
    return spark.createDataFrame([("a.py", CODE), ("b.py", "job.commit()\nGlueContext\ndef last():")], "file_path string, content string")


def test_review_findings(code):
    got = {(r.file_path, r.line_number, r.rule) for r in rv.review_findings(code, ["file_path"]).collect()}
    assert got == {
        ("a.py", 2, "missing_glue_context"),
        ("a.py", 3, "hardcoded_paths"),
        ("a.py", 3, "missing_error_handling"),
        ("a.py", 3, "missing_schema"),
        ("a.py", 3, "inefficient_file_format"),
        ("a.py", 4, "expensive_operations"),
        ("a.py", 7, "missing_docstring"),
        ("a.py", 0, "missing_glue_imports"),
        ("a.py", 0, "missing_job_commit"),
    }


def test_review_metrics(code):
    got = {r.file_path: r for r in rv.review_metrics(code, ["file_path"]).collect()}
    assert (got["a.py"].lines, got["a.py"].issues, got["a.py"].n_error, got["a.py"].n_style) == (8, 9, 1, 1)
    assert (got["b.py"].lines, got["b.py"].issues) == (3, 0)


def test_inventory(spark):
    job = 'import pyspark\na = spark.read.parquet("p")\nb = spark.table("t")\nc = a.select("x").filter("x > 1").join(b, "x")\nc.count()'
    df = spark.createDataFrame(
        [("job.py", job), ("q.sql", "SELECT 1"), ("x.py", "print(1)")], "file_path string, content string"
    )
    inv = {r.file_path: r for r in rv.file_inventory(df, ["file_path"]).collect()}
    one = inv["job.py"]
    assert one.is_pyspark and one.tags == ["joins", "filtering", "projections"] and one.sources == ["p", "t"]
    assert one.n_performance == 1 and one.use_broadcast and one.filter_earlier and not one.use_cache
    assert not inv["x.py"].is_pyspark and inv["q.sql"].kind == "sql"
    total = rv.codebase_totals(rv.file_inventory(df, ["file_path"])).first()
    assert (total.n_files, total.n_pyspark, total.n_sql, total.n_joins, total.n_sources) == (3, 1, 1, 1, 2)
