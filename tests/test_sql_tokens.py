import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import sql_tokens as st
from tests.conftest import executed_plan


def features(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, sql string")
    return [r for r in st.features(st.token_table(df, "id", "sql"), "id").orderBy("id").collect()]


def tables(spark, *texts):
    return [sorted(f"{t.schema_name or ''}.{t.table_name}" for t in r.tables) for r in features(spark, *texts)]


def test_tokens_of_a_text(spark):
    text = "a--x\n'it''s'/*y*/\"q \"\"z\"`b`1.5e3::$$p $$ <>é_1('"
    got = spark.range(1).select(st.raw_tokens(F.lit(text)).alias("t")).first().t
    assert got == ["a", "--x", "'it''s'", "/*y*/", '"q ""z"', "`b`", "1.5e3", "::", "$$p $$", "<>", "é_1", "(", "'"]


CASES = {
    "SELECT 'from a join b' FROM t -- join u\n JOIN s.v ON 1=1": [".t", "s.v"],
    "SELECT EXTRACT(YEAR FROM d), TRIM(BOTH ' ' FROM e) FROM x.y.z, w": [".w", "y.z"],
    "WITH a AS (SELECT 1 FROM b), c (k) AS MATERIALIZED (SELECT k FROM a) SELECT * FROM c, d, x.a": [".b", ".d", "x.a"],
    "SELECT * FROM (SELECT 1 FROM a, b) q, c WHERE k IS NOT DISTINCT FROM d": [".a", ".b", ".c"],
    "SELECT f(a, b), substring(x FROM 2) FROM generate_series(1, 2) g JOIN LATERAL (SELECT 1 FROM ONLY h) l ON g(1, 2) = l, m": [".h", ".m"],
    "SELECT 1 FROM \"From\" JOIN `odd name` ON true": [".From", ".odd name"],
    "SELECT 1 FROM T; SELECT a, b FROM u": [".t", ".u"],
    "SELECT cast(a AS timestamp with time zone), b FROM t": [".t"],
    "SELECT 1 FROM t ORDER BY a, b": [".t"],
    "FROM": [],
    "SELECT a FROM t WHERE b IN ('x', $$ FROM n $$) /* FROM o": [".t"],
}


def test_tables(spark):
    assert dict(zip(CASES, tables(spark, *CASES))) == CASES


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("SELECT string_agg(x, ',' ORDER BY y) FROM t WHERE a", {"has_order": False, "n_aggregate": 1, "n_strings": 1}),
        ("SELECT sum(a) OVER (ORDER BY b), max(c) OVER w FROM t", {"has_order": False, "n_window": 2, "n_subquery": 0}),
        ("SELECT * FROM (SELECT a FROM t ORDER BY a) q", {"has_order": True, "n_subquery": 1, "select_star": True}),
        ("WITH a AS (SELECT 1), b AS (WITH c AS (SELECT 2) SELECT 3) SELECT (SELECT 4)", {"n_cte": 3, "n_subquery": 1}),
        ("SELECT CASE WHEN a THEN 1 END CASE FROM t", {"n_case": 1}),
        ("SELECT ')' , \"(\" /* ( */ -- (", {"unbalanced_parentheses": False, "max_depth": 0, "n_comments": 2}),
        ("SELECT a) (", {"unbalanced_parentheses": True}),
        ("SELECT 'a", {"open_string": True, "n_strings": 1}),
        ("SELECT 'it''s'", {"open_string": False, "n_strings": 1}),
        ("SELECT DISTINCT * FROM t LIMIT 3", {"select_star": True, "distinct": True, "has_limit": True, "has_where": False}),
        ("SELECT 'where' FROM app_db_eu_7_main", {"has_where": False, "multi_tenant": True}),
        ("", {"n_join": 0, "n_strings": 0, "has_select": False, "tables": [], "open_string": False}),
        (None, {"n_join": 0, "max_depth": 0, "unbalanced_parentheses": False, "tables": []}),
    ],
)
def test_features(spark, text, wanted):
    row = features(spark, text)[0]
    assert {k: row[k] for k in wanted} == wanted


def by_hand(text):
    """(joins, strings, comments, open end, words and parentheses) by reading one character after the other."""
    i, out = 0, {"n_join": 0, "n_strings": 0, "n_comments": 0, "open_string": False, "max_depth": 0}
    depth, lowest, word = 0, 0, ""
    text += "\n"
    while i < len(text):
        ch, two = text[i], text[i : i + 2]
        if ch.isalnum() or ch == "_" or (word and ch in "$#"):  # a name may hold a dollar sign
            word += ch
            i += 1
            continue
        out["n_join"] += word.lower() == "join"
        word = ""
        if two == "--":
            out["n_comments"] += 1
            i = text.index("\n", i)
        elif two in ("/*", "$$"):
            out["n_comments" if two == "/*" else "n_strings"] += 1
            end = text.find("*/" if two == "/*" else "$$", i + 2, len(text) - 1)
            out["open_string"] |= end < 0
            i = len(text) if end < 0 else end + 2
        elif ch in "'\"`":
            out["n_strings"] += ch == "'"
            i += 1
            while i < len(text) - 1 and (text[i] != ch or (ch != "`" and text[i : i + 2] == ch * 2)):
                i += 2 if text[i] == ch else 1
            out["open_string"] |= ch == "'" and i >= len(text) - 1
            i += 1
        else:
            depth += (ch == "(") - (ch == ")")
            out["max_depth"], lowest = max(out["max_depth"], depth), min(lowest, depth)
            i += 1
    return out | {"unbalanced_parentheses": depth != 0 or lowest < 0}


def test_random_texts_against_a_reader_of_characters(spark):
    parts = ["join", " JOIN ", "'", "''", '"', "`", "--", "/*", "*/", "$$", "\n", "(", ")", " ", "x", "_1", "é", "from t", "'a(b'"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(1500)]
    for text, row in zip(texts, features(spark, *texts)):
        wanted = by_hand(text)
        assert {k: row[k] for k in wanted} == wanted, text


def test_long_text_repeated_text_null_key_and_clashing_columns(spark):
    text = "SELECT " + "'" + "x''" * 200_000 + "' FROM " + ", ".join(f"t{i}" for i in range(3000))
    data = [(None, text, "a"), (2, "SELECT 1 FROM a", "b"), (3, "SELECT 1 FROM a", "c")]
    df = spark.createDataFrame(data, "key long, token string, depth string")
    got = {r.key: len(r.tables) for r in st.features(st.token_table(df, "key", "token"), "key").collect()}
    assert got == {None: 3000, 2: 1, 3: 1}
    assert st.features(st.token_table(df.limit(0), "key", "token"), "key").count() == 0


def test_one_shuffle_by_statement(spark, tables):
    from millrace.plans.derived import sql_token_corpus

    whole = sql_token_corpus(tables)
    plan = executed_plan(st.features(st.token_table(whole, "stmt_id", "sql"), "stmt_id"))
    final = plan.split("Initial Plan")[0]
    assert final.count("hashpartitioning") == 1 and "Python" not in final


def test_tokens_are_neither_sorted_nor_moved(spark, tables):
    """Windows over a row per token shuffled, sorted and spilled many times the texts."""
    from millrace.plans.derived import sql_token_corpus

    plan = executed_plan(st.features(st.token_table(sql_token_corpus(tables), "stmt_id", "sql"), "stmt_id"))
    final = plan.split("Initial Plan")[0]
    assert "explode" not in final and final.count("Window [") == 1


def test_deep_parentheses_and_repeated_keys(spark):
    deep = "SELECT 1 FROM " + "(" * 3000 + "SELECT a FROM b" + ")" * 3000 + ", c"
    df = spark.createDataFrame([(1, deep), (2, "SELECT a JOIN b"), (2, "SELECT a JOIN b"), (3, ") SELECT (FROM d) FROM e")], "id long, sql string")
    got = {r.id: r for r in st.features(st.token_table(df, "id", "sql"), "id").collect()}
    assert [(t.schema_name, t.table_name) for t in got[1].tables] == [(None, "b"), (None, "c")] and got[1].max_depth == 3000
    assert got[2].n_join == 2 and [t.table_name for t in got[2].tables] == ["join", "b"] and len(got) == 3  # tokens of both rows, in turn
    assert got[3].unbalanced_parentheses and {t.table_name for t in got[3].tables} == {"d", "e"}
