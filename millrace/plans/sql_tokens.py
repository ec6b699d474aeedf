"""Analyses of SQL text on its tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import corpus as cp, sql_tokens as st
from millrace.plans.derived import SQL_TOKEN_CORPUS, sql_token_corpus
from millrace.plans.registry import Tables, plan


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# RE2 needs no possessive loops
TOKEN = st.TOKEN.replace("++", "+").replace("*+", "*").replace("'", "''")
NAME = f'^(?:"|{st.LETTER})'
ODD_QUOTES = "(length(r) - length(replace(r, chr(39), ''))) % 2 <> 0"
OPEN = (
    f"(starts_with(r, chr(39)) AND {ODD_QUOTES}) OR (starts_with(r, '$$') AND (length(r) < 4 OR NOT ends_with(r, '$$'))) "
    "OR (starts_with(r, '/*') AND (length(r) < 4 OR NOT ends_with(r, '*/')))"
)
LEADS = ", ".join(f"LEAD(token, {k}) OVER w AS n{k}" for k in range(1, st.AHEAD + 1))
BEHIND = [f"(CASE WHEN n1 IN ('only', 'lateral') THEN n{k + 1} ELSE n{k} END)" for k in range(1, st.AHEAD)]
A, B, C, D, E, G = BEHIND
SECOND = f"({B} = '.' AND regexp_matches({C}, '{NAME}'))"
THIRD = f"({SECOND} AND {D} = '.' AND regexp_matches({E}, '{NAME}'))"
CTE_NAME = f"clause = 'with' AND prev IN ('with', 'recursive', ',') AND token <> 'recursive' AND regexp_matches(token, '{NAME}')"
SELECT_STAR = "token = 'select' AND (n1 = '*' OR (n1 = 'distinct' AND n2 = '*'))"
ORDER_BY = "token = 'order' AND n1 = 'by' AND COALESCE(first_inside IN ('select', 'with', '('), TRUE)"

TOKENS = f"""
    WITH raws AS (SELECT stmt_id, regexp_extract_all(COALESCE(sql, ''), '{TOKEN}') AS raw FROM ({SQL_TOKEN_CORPUS})),
    shorts AS (
      SELECT stmt_id, len(list_filter(raw, lambda r: regexp_matches(r, '{st.COMMENT}'))) AS n_comments, len(list_filter(raw, lambda r: {OPEN})) > 0 AS open_string,
             list_transform(list_filter(raw, lambda r: NOT regexp_matches(r, '{st.COMMENT}')), lambda r:
               CASE WHEN r[1] = chr(39) OR starts_with(r, '$$') THEN chr(39)
                    WHEN r[1] = '"' THEN '"' || replace(regexp_replace(r, '^"|"\\z', '', 'g'), '""', '"')
                    WHEN r[1] = '`' THEN '"' || replace(r, '`', '') ELSE lower(r) END) AS tokens FROM raws),
    cut AS (SELECT stmt_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM shorts),
    placed AS (
      SELECT *, SUM(CASE token WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS depth,
             LAG(token, 1) OVER w AS prev, LAG(token, 2) OVER w AS prev2, {LEADS} FROM cut WINDOW w AS (PARTITION BY stmt_id ORDER BY pos)),
    marked AS (SELECT *, COALESCE(prev = 'distinct' AND prev2 IN ('is', 'not'), FALSE) AS compares FROM placed),
    tokens AS (
      SELECT *, last_value(CASE WHEN token = '(' THEN COALESCE(prev, '') END IGNORE NULLS) OVER d AS fn,
             last_value(CASE WHEN token = '(' THEN COALESCE(n1, '') END IGNORE NULLS) OVER d AS first_inside,
             last_value(CASE WHEN (token IN ('(', ';', {words(st.CLAUSES)}) AND NOT (token = 'from' AND compares))
                               OR (token = 'with' AND NOT COALESCE(n1 IN ({words(st.NOT_A_CTE)}), FALSE)) THEN token END IGNORE NULLS) OVER d AS clause
      FROM marked WINDOW d AS (PARTITION BY stmt_id, depth ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    ctes AS (SELECT DISTINCT stmt_id, regexp_replace(token, '^"', '') AS name FROM tokens WHERE {CTE_NAME}),
    found AS (
      SELECT DISTINCT stmt_id, regexp_replace(CASE WHEN {THIRD} THEN {C} WHEN {SECOND} THEN {A} END, '^"', '') AS schema_name,
             regexp_replace(CASE WHEN {THIRD} THEN {E} WHEN {SECOND} THEN {C} ELSE {A} END, '^"', '') AS table_name FROM tokens
      WHERE ((token = 'from' AND NOT compares) OR token = 'join' OR (token = ',' AND clause IN ({words(st.FROM_CLAUSES)})))
        AND NOT COALESCE(fn IN ({words(st.FROM_FUNCTIONS)}), FALSE) AND regexp_matches({A}, '{NAME}')
        AND COALESCE(CASE WHEN {THIRD} THEN {G} WHEN {SECOND} THEN {D} ELSE {B} END, '') <> '('),
    tables AS (SELECT * FROM found f WHERE schema_name IS NOT NULL OR NOT EXISTS (SELECT 1 FROM ctes c WHERE c.stmt_id = f.stmt_id AND c.name = f.table_name)),
    grouped AS (
      SELECT stmt_id, COUNT(*) FILTER (token = chr(39)) AS n_strings, GREATEST(0, MAX(depth)) AS max_depth, COUNT(*) FILTER ({CTE_NAME}) AS n_cte,
             COUNT(*) FILTER (token = 'over' AND (n1 = '(' OR (prev = ')' AND regexp_matches(n1, '{NAME}')))) AS n_window,
             COUNT(*) FILTER (token = '(' AND n1 IN ('select', 'with'))
               - COUNT(*) FILTER (clause = 'with' AND token IN ('as', 'materialized') AND n1 = '(' AND n2 IN ('select', 'with')) AS n_subquery,
             COUNT(*) FILTER (token = 'join') AS n_join, COUNT(*) FILTER (token = 'case' AND COALESCE(prev, '') <> 'end') AS n_case,
             COUNT(*) FILTER (token IN ({words(st.AGGREGATES)}) AND n1 = '(') AS n_aggregate,
             COUNT(*) FILTER (token = 'select') > 0 AS has_select, COUNT(*) FILTER ({SELECT_STAR}) > 0 AS select_star,
             COUNT(*) FILTER (token = 'where') > 0 AS has_where, COUNT(*) FILTER ({ORDER_BY}) > 0 AS has_order,
             COUNT(*) FILTER (token IN ('limit', 'fetch') OR (token = 'top' AND prev IN ('select', 'distinct'))) > 0 AS has_limit,
             COUNT(*) FILTER (token = 'select' AND n1 = 'distinct') > 0 AS is_distinct,
             COUNT(*) FILTER (regexp_matches(token, '{st.TENANT_WORD}')) > 0 AS multi_tenant,
             COUNT(*) FILTER (token = '(') <> COUNT(*) FILTER (token = ')') OR MIN(depth) < 0 AS unbalanced FROM tokens GROUP BY stmt_id),
    features AS (
      SELECT s.stmt_id, n_comments, open_string, {', '.join(f'COALESCE(CAST({c} AS BIGINT), 0) AS {c}' for c in ('n_strings', 'max_depth', 'n_cte', 'n_window', 'n_subquery', 'n_join', 'n_case', 'n_aggregate'))},
             {', '.join(f'COALESCE({c}, FALSE) AS {c}' for c in ('has_select', 'select_star', 'has_where', 'has_order', 'has_limit', 'is_distinct', 'multi_tenant', 'unbalanced'))}
      FROM shorts s LEFT JOIN grouped g ON s.stmt_id = g.stmt_id)
"""

COUNTS = ("n_comments", "n_strings", "max_depth", "n_cte", "n_window", "n_subquery", "n_join", "n_case", "n_aggregate")
COMPLEXITY = (
    "CAST(CASE WHEN has_select THEN 1 ELSE 0 END + 2 * n_join + CASE WHEN n_subquery + n_cte > 0 THEN 3 ELSE 0 END + 2 * n_case + 2 * n_window AS BIGINT)"
)
RULES = {
    "select_star": "select_star",
    "several_joins": "n_join > 3",
    "many_joins": "n_join > 5",
    "some_join": "n_join BETWEEN 1 AND 3",
    "no_where": "has_select AND NOT has_where",
    "order_without_limit": "has_order AND NOT has_limit",
    "distinct": "is_distinct",
    "multi_tenant": "multi_tenant",
    "unbalanced_parentheses": "unbalanced",
    "open_string": "open_string",
}


def _features(t: Tables) -> DataFrame:
    return st.features(st.token_table(sql_token_corpus(t), "stmt_id", "sql"), "stmt_id")


@plan(
    "sql_token_constructs",
    TOKENS + f"SELECT stmt_id, {', '.join(COUNTS)}, n_join > 2 AS complex_joins, {COMPLEXITY} AS score FROM features",
)
def sql_token_constructs(t: Tables) -> DataFrame:
    return _features(t).select("stmt_id", *COUNTS, (F.col("n_join") > 2).alias("complex_joins"), st.complexity().alias("score"))


@plan("sql_token_tables", TOKENS + "SELECT stmt_id, schema_name, table_name FROM tables")
def sql_token_tables(t: Tables) -> DataFrame:
    return st.table_index(_features(t), "stmt_id")


@plan("sql_token_usage", TOKENS + "SELECT schema_name, table_name, COUNT(*) AS n_statements FROM tables GROUP BY 1, 2")
def sql_token_usage(t: Tables) -> DataFrame:
    index = st.table_index(_features(t), "stmt_id")
    return index.groupBy("schema_name", "table_name").agg(F.count(F.lit(1)).alias("n_statements"))


@plan(
    "sql_token_lint",
    TOKENS + " UNION ALL ".join(f"SELECT stmt_id, '{n}' AS rule FROM features WHERE {r}" for n, r in RULES.items()),
)
def sql_token_lint(t: Tables) -> DataFrame:
    return cp.findings(_features(t), ["stmt_id"], st.lint_rules())


@plan(
    "sql_token_rollup",
    TOKENS
    + f"""
    , per_file AS (SELECT {' + '.join(f"CASE WHEN {RULES[n]} THEN 1 ELSE 0 END" for n in cp.OPPORTUNITIES)} AS opportunities, {COMPLEXITY} AS complexity, multi_tenant FROM features)
    SELECT COUNT(*) AS n_files, CAST(SUM(opportunities) AS BIGINT) AS opportunities, COUNT(*) FILTER (multi_tenant) AS multi_tenant,
           COUNT(*) FILTER (complexity > 7) AS high_complexity, CAST(LEAST(SUM(opportunities) * 5, 50) AS BIGINT) AS improvement_percent FROM per_file
    """,
)
def sql_token_rollup(t: Tables) -> DataFrame:
    files = _features(t).select(
        st.opportunities(cp.OPPORTUNITIES).alias("opportunities"), st.complexity().alias("complexity"), "multi_tenant"
    )
    return cp.workspace_totals(files)
