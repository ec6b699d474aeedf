"""SQL corpus analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import corpus as cp
from millrace.plans.derived import SQL_CORPUS, SQL_FILES, sql_corpus, sql_files
from millrace.plans.registry import Tables, plan
from millrace.session import spread

KEYWORDS = ", ".join(f"'{k}'" for k in cp.SQL_KEYWORDS)
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def clean(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '{WS}', ' ', 'g'), '[^\\x00-\\x7F]+', ' ', 'g'), '\\x00', ' ', 'g'))"
    )


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def valid(x: str) -> str:
    b = strip(x)
    return (
        f"(length({b}) >= 10 AND regexp_extract(upper({b}), '^(\\S+)', 1) IN ({KEYWORDS}) "
        f"AND NOT (contains(upper({x}), 'SELECT') AND NOT contains(upper({x}), 'FROM')))"
    )


def occurs(x: str, word: str) -> str:
    quoted = word.replace("'", "''")
    return f"CAST((length({x}) - length(replace({x}, '{quoted}', ''))) / {len(word)} AS INTEGER)"


def count(x: str, pattern: str, flags: str = "") -> str:
    return f"CAST(len(regexp_extract_all({x}, '{flags}{pattern}')) AS INTEGER)"


def any_of(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def confidence(x: str) -> str:
    u = f"upper({x})"
    return (
        f"CAST(GREATEST(0, LEAST(1, 0.5 + CASE WHEN regexp_matches({x}, ';\\s*$') THEN 0.2 ELSE 0 END"
        f" + CASE WHEN contains({u}, 'SELECT') AND contains({u}, 'FROM') THEN 0.2 ELSE 0 END"
        f" + CASE WHEN {any_of(u, 'WHERE', 'GROUP BY', 'ORDER BY', 'HAVING')} THEN 0.1 ELSE 0 END"
        f" - CASE WHEN {count(x, '\\S+')} < 5 THEN 0.2 ELSE 0 END"
        f" - CASE WHEN {occurs(x, '(')} <> {occurs(x, ')')} THEN 0.1 ELSE 0 END)) AS DOUBLE)"
    )


def normal(x: str) -> str:
    return f"trim(regexp_replace(upper({x}), '\\s+', ' ', 'g'))"


def cut(pattern: str) -> str:
    return f"regexp_split_to_array(content, '{pattern}')"


PATTERNS = [
    rf"(?is)\b({cp.STATEMENT_KEYWORDS})\b.*?;",
    rf"(?is)\b({cp.STATEMENT_KEYWORDS})\b.*",
    rf"(?is)\b({cp.STATEMENT_KEYWORDS})\b[^;]*$",
]


@plan(
    "extract_sql",
    f"""
    WITH files AS ({SQL_FILES}),
    cuts AS (SELECT file_path, content, {cut(cp.SEPARATORS[0])} AS a, {cut(cp.SEPARATORS[1])} AS b, {cut(cp.SEPARATORS[2])} AS c FROM files),
    best AS (SELECT file_path, content, CASE WHEN GREATEST(1, len(a), len(b), len(c)) = 1 THEN [content]
             WHEN len(a) = GREATEST(len(a), len(b), len(c)) THEN a WHEN len(b) = GREATEST(len(a), len(b), len(c)) THEN b ELSE c END AS parts FROM cuts),
    stripped AS (SELECT file_path, content, list_filter(list_transform(parts, lambda p: {strip('p')}), lambda p: p <> '') AS parts FROM best),
    exploded AS (SELECT file_path, content, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM stripped),
    lines AS (SELECT *, 1 + COALESCE(SUM({occurs('part', chr(10))} + 2) OVER (PARTITION BY file_path ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_number,
                     COUNT(*) FILTER ({valid('part')}) OVER (PARTITION BY file_path) AS n_valid FROM exploded),
    single AS (SELECT DISTINCT file_path, content FROM lines WHERE n_valid <= 1),
    found AS (SELECT file_path, 1 AS line_number, unnest(f) AS statement, generate_subscripts(f, 1) AS pos FROM (
              SELECT file_path, {' || '.join(f"regexp_extract_all({clean('content')}, '{p}')" for p in PATTERNS)} AS f FROM single)),
    every AS (SELECT file_path, {clean('part')} AS statement, line_number, pos FROM lines WHERE n_valid > 1 AND {valid('part')}
              UNION ALL SELECT file_path, trim(statement), line_number, pos FROM found WHERE {valid('statement')}),
    firsts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY file_path, {normal('statement')} ORDER BY pos) AS rn FROM every)
    SELECT file_path, statement, CAST(line_number AS BIGINT) AS line_number, {confidence('statement')} AS confidence FROM firsts WHERE rn = 1
    """,
)
def extract_sql(t: Tables) -> DataFrame:
    return cp.extract_statements(sql_files(t))


@plan("clean_text", f"SELECT doc_id, {clean('text')} AS cleaned FROM documents")
def clean_text(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text")).select("doc_id", cp.clean_text("text").alias("cleaned"))


@plan("valid_sql", f"SELECT stmt_id, {valid('sql')} AS valid FROM ({SQL_CORPUS})")
def valid_sql(t: Tables) -> DataFrame:
    return sql_corpus(t).select("stmt_id", cp.valid_sql("sql").alias("valid"))


@plan("sql_confidence", f"SELECT stmt_id, {confidence('sql')} AS confidence FROM ({SQL_CORPUS})")
def sql_confidence(t: Tables) -> DataFrame:
    return sql_corpus(t).select("stmt_id", cp.confidence("sql").alias("confidence"))


@plan(
    "dedup_sql",
    f"""
    SELECT stmt_id, sql, {confidence('sql')} AS confidence FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY {normal('sql')} ORDER BY stmt_id) AS rn FROM ({SQL_CORPUS})) WHERE rn = 1
    """,
)
def dedup_sql(t: Tables) -> DataFrame:
    kept = cp.dedup_statements(sql_corpus(t), "sql", "stmt_id")
    scored = kept.withColumn("confidence", cp.confidence("sql"))
    return scored.orderBy(F.desc("confidence"), "stmt_id")


def dialect_case(x: str) -> str:
    whens = " ".join(
        f"WHEN {any_of(f'lower({x})', *marks)} THEN '{name}'" for name, marks in cp.DIALECT_MARKS
    )
    return f"CASE {whens} ELSE 'spark' END"


def syntax_case(x: str) -> str:
    low = f"lower({x})"
    return (
        f"CASE WHEN contains({x}, '::') AND {any_of(low, 'interval', 'now()')} THEN 'postgres' "
        f"WHEN {any_of(low, 'dual', 'sysdate')} THEN 'oracle' "
        f"WHEN contains({low}, 'getdate()') OR contains({x}, '[') THEN 'sqlserver' ELSE 'standard' END"
    )


@plan(
    "sql_dialect",
    f"SELECT stmt_id, {dialect_case('sql')} AS by_functions, {syntax_case('sql')} AS by_syntax FROM ({SQL_CORPUS})",
)
def sql_dialect(t: Tables) -> DataFrame:
    return sql_corpus(t).select(
        "stmt_id",
        cp.dialect_by_functions("sql").alias("by_functions"),
        cp.dialect_by_syntax("sql").alias("by_syntax"),
    )


def complexity(x: str) -> str:
    low = f"lower({x})"
    return (
        f"(CASE WHEN contains({low}, 'select') THEN 1 ELSE 0 END + {occurs(low, 'join')} * 2 "
        f"+ CASE WHEN regexp_matches({low}, '(?s)\\(.*select.*\\)') THEN 3 ELSE 0 END "
        f"+ {count(low, 'case\\s+when')} * 2 + {count(low, 'over\\s*\\(')} * 2)"
    )


@plan(
    "sql_complexity",
    f"""
    SELECT stmt_id, {complexity('sql')} AS score, {count('sql', '\\bJOIN\\b', '(?i)')} * 2 + {count('sql', '\\bCASE\\b', '(?i)')}
           + {count('sql', '\\bSUBSTRING\\b', '(?i)')} + {count('sql', '::bit|::int|::text', '(?i)')} * 3 AS keyword_score
    FROM ({SQL_CORPUS})
    """,
)
def sql_complexity(t: Tables) -> DataFrame:
    return sql_corpus(t).select(
        "stmt_id",
        cp.complexity("sql").alias("score"),
        cp.complexity_by_keywords("sql").alias("keyword_score"),
    )


TABLES_OF = r"list_distinct(regexp_extract_all(sql, '(?i)(?:FROM|JOIN)\s+(?:\w+\.)?(\w+)', 1))"


@plan("sql_tables", f"SELECT unnest({TABLES_OF}) AS table_name, stmt_id FROM ({SQL_CORPUS})")
def sql_tables(t: Tables) -> DataFrame:
    return cp.table_index(sql_corpus(t), "stmt_id", "sql")


@plan(
    "sql_table_usage",
    f"SELECT table_name, COUNT(*) AS n_statements FROM (SELECT unnest({TABLES_OF}) AS table_name FROM ({SQL_CORPUS})) GROUP BY 1",
)
def sql_table_usage(t: Tables) -> DataFrame:
    index = cp.table_index(sql_corpus(t), "stmt_id", "sql")
    return index.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_statements"))


@plan(
    "sql_schemas",
    f"""
    SELECT schema_name, COUNT(*) AS n_statements FROM (
      SELECT unnest(list_distinct(list_transform(regexp_extract_all(sql, '(\\w+_db_\\w+_\\d+_\\w+|\\w+\\.\\w+)', 1),
                                                 lambda s: split_part(s, '.', 1)))) AS schema_name FROM ({SQL_CORPUS})) GROUP BY 1
    """,
)
def sql_schemas(t: Tables) -> DataFrame:
    exploded = sql_corpus(t).select(F.explode(cp.schemas_of("sql")).alias("schema_name"))
    return exploded.groupBy("schema_name").agg(F.count(F.lit(1)).alias("n_statements"))


TENANTS = r"regexp_extract_all(sql, '\w+_db_\w+_(\d+)_\w+', 1)"


@plan(
    "tenant_rollup",
    f"""
    SELECT tenant, COUNT(*) AS n_statements, COUNT(*) FILTER (shared) AS n_shared FROM (
      SELECT len({TENANTS}) > 1 AS shared, unnest(list_distinct({TENANTS})) AS tenant FROM ({SQL_CORPUS})) GROUP BY tenant
    """,
)
def tenant_rollup(t: Tables) -> DataFrame:
    return cp.tenant_rollup(sql_corpus(t), "sql")


LOW = "lower(sql)"
CTES = f"CASE WHEN regexp_matches({LOW}, '^\\s*with\\b') THEN {count(LOW, '\\bas\\s*\\(\\s*select\\b')} ELSE 0 END"


@plan(
    "sql_constructs",
    f"""
    SELECT stmt_id, {CTES} AS n_cte, {count(LOW, '\\bover\\s*\\(')} AS n_window, {count(LOW, '\\(\\s*select\\b')} - {CTES} AS n_subquery,
           {count(LOW, '\\bjoin\\b')} AS n_join, {count(LOW, '\\bcase\\b')} AS n_case,
           {count(LOW, '\\b(?:count|sum|avg|min|max|string_agg|array_agg)\\s*\\(')} AS n_aggregate,
           {count(LOW, '\\bjoin\\b')} > 2 AS complex_joins FROM ({SQL_CORPUS})
    """,
)
def sql_constructs(t: Tables) -> DataFrame:
    found = cp.constructs("sql")
    return sql_corpus(t).select(
        "stmt_id", *[c.alias(n) for n, c in found.items()], (found["n_join"] > 2).alias("complex_joins")
    )


RULES = {
    "select_star": "contains(lower(sql), 'select *')",
    "several_joins": f"{occurs(LOW, 'join')} > 3",
    "many_joins": f"{occurs(LOW, 'join')} > 5",
    "some_join": f"{occurs(LOW, 'join')} BETWEEN 1 AND 3",
    "no_where": "contains(lower(sql), 'select') AND NOT contains(lower(sql), 'where')",
    "order_without_limit": "contains(lower(sql), 'order by') AND NOT contains(lower(sql), 'limit')",
    "distinct": "contains(lower(sql), 'distinct')",
    "multi_tenant": r"regexp_matches(sql, '\w+_db_\w+_(\d+)_\w+')",
    "unbalanced_parentheses": f"{occurs('sql', '(')} <> {occurs('sql', ')')}",
    "open_string": f"{occurs('sql', chr(39))} % 2 <> 0",
}


@plan(
    "sql_lint",
    f"WITH c AS ({SQL_CORPUS}) "
    + " UNION ALL ".join(f"SELECT stmt_id, '{n}' AS rule FROM c WHERE {r}" for n, r in RULES.items()),
)
def sql_lint(t: Tables) -> DataFrame:
    return cp.findings(sql_corpus(t), ["stmt_id"], cp.lint_rules("sql"))


WORKSPACE = f"""
    SELECT stmt_id, {' + '.join(f"CASE WHEN {RULES[n]} THEN 1 ELSE 0 END" for n in cp.OPPORTUNITIES)} AS opportunities,
           {complexity('sql')} AS complexity, {RULES['multi_tenant']} AS multi_tenant, {syntax_case('sql')} AS dialect
    FROM ({SQL_CORPUS}) WHERE {any_of(LOW, *cp.SQL_WORDS)}
"""


@plan("workspace_files", WORKSPACE)
def workspace_files(t: Tables) -> DataFrame:
    return cp.workspace_files(sql_corpus(t), ["stmt_id"], "sql")


@plan(
    "workspace_rollup",
    f"""
    SELECT COUNT(*) AS n_files, CAST(SUM(opportunities) AS BIGINT) AS opportunities, COUNT(*) FILTER (multi_tenant) AS multi_tenant,
           COUNT(*) FILTER (complexity > 7) AS high_complexity, CAST(LEAST(SUM(opportunities) * 5, 50) AS BIGINT) AS improvement_percent
    FROM ({WORKSPACE})
    """,
)
def workspace_rollup(t: Tables) -> DataFrame:
    return cp.workspace_totals(cp.workspace_files(sql_corpus(t), ["stmt_id"], "sql"))
