"""Analyses of SQL text at corpus scale: extraction, validity, dialect, complexity, lint.

Everything is a column expression over one row per file or statement. Rules become arrays
of findings that are exploded, so a rule set never needs a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.windows import latest_per_key
from millrace.session import spread

# --- fixed values ------------------------------------------------------------------

SQL_KEYWORDS = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "WITH", "MERGE", "TRUNCATE",
    "GRANT", "REVOKE", "EXPLAIN", "ANALYZE",
]
STATEMENT_KEYWORDS = "SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|WITH|MERGE|TRUNCATE"
SEPARATORS = (
    r"\n\s*-{3,}[^\n]*\n",  # a line of dashes
    r"\n\s*--[^\n]*\n",  # a comment line
    r"\n\s*\n\s*\n",  # blank lines
)
DIALECT_MARKS = (
    ("postgres", ("string_agg", "array_agg", "extract(", "regexp_replace")),
    ("oracle", ("nvl(", "decode(", "rownum", "sysdate", "dual")),
    ("redshift", ("dateadd(", "datediff(", "getdate()", "isnull(")),
)
SQL_WORDS = ("select", "from", "where", "join", "insert", "update", "delete", "with")
TENANT_SCHEMA = r"\w+_db_\w+_(\d+)_\w+"
SCHEMA_NAME = r"(\w+_db_\w+_\d+_\w+|\w+\.\w+)"
TABLE_NAME = r"(?i)(?:FROM|JOIN)\s+(?:\w+\.)?(\w+)"
WHITESPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"

# --- helpers -----------------------------------------------------------------------


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def has(text: Column, *words: str) -> Column:
    """Whether any of the words occurs."""
    out = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        out = out | F.contains(text, F.lit(word))
    return out


def occurrences(text: Column, word: str) -> Column:
    """How often a fixed word occurs."""
    shrunk = F.length(F.replace(text, F.lit(word), F.lit("")))
    return ((F.length(text) - shrunk) / len(word)).cast("int")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(text, F.lit(r"\S+"))


# --- statements --------------------------------------------------------------------


def clean_text(text: str | Column) -> Column:
    """Whitespace runs to one blank, other than ASCII and NUL to a blank, ends trimmed."""
    out = F.regexp_replace(_col(text), WHITESPACE, " ")
    out = F.regexp_replace(out, r"[^\x00-\x7F]+", " ")
    return F.trim(F.replace(out, F.lit("\x00"), F.lit(" ")))


def normalized(text: str | Column) -> Column:
    """Form in which two statements count as the same."""
    return F.trim(F.regexp_replace(F.upper(_col(text)), r"\s+", " "))


def valid_sql(text: str | Column) -> Column:
    """Ten characters or more, a SQL keyword first, and no SELECT without FROM."""
    body = F.trim(F.regexp_replace(_col(text), r"^\s+|\s+$", ""))
    upper = F.upper(body)
    first = F.regexp_extract(upper, r"^(\S+)", 1)
    return (
        (F.length(body) >= 10)
        & first.isin(*SQL_KEYWORDS)
        & ~(has(upper, "SELECT") & ~has(upper, "FROM"))
    )


def confidence(text: str | Column) -> Column:
    """How much a text looks like a whole statement, 0 to 1 in tenths."""
    body = _col(text)
    upper = F.upper(body)

    def when(cond: Column, amount: str) -> Column:
        return F.when(cond, F.lit(amount).cast("decimal(4,1)")).otherwise(F.lit("0.0").cast("decimal(4,1)"))

    score = (
        F.lit("0.5").cast("decimal(4,1)")
        + when(body.rlike(r";\s*$"), "0.2")
        + when(has(upper, "SELECT") & has(upper, "FROM"), "0.2")
        + when(has(upper, "WHERE", "GROUP BY", "ORDER BY", "HAVING"), "0.1")
        - when(words(body) < 5, "0.2")
        - when(occurrences(body, "(") != occurrences(body, ")"), "0.1")
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score.cast("double")))


def extract_statements(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """(file_path, statement, line_number, confidence) of every statement in the files.

    A file is cut at the separator that gives the most parts. If that leaves one valid
    statement or none, statements are looked for by pattern in the cleaned text instead.
    Equal statements of a file count once, the first of them.
    """
    files = spread(files.select(F.col(path).alias("file_path"), F.col(content).alias("content")))
    whole = F.array(F.col("content"))
    for i, sep in enumerate(SEPARATORS):
        files = files.withColumn(f"cut{i}", F.split(F.col("content"), sep, -1))
    cuts = [F.col(f"cut{i}") for i in range(len(SEPARATORS))]
    most = F.greatest(F.lit(1), *[F.size(c) for c in cuts])
    # the whole text, then the separators in their order, win a tie
    parts = F.when(most == 1, whole)
    for cut in cuts:
        parts = parts.when(F.size(cut) == most, cut)
    strip = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    # Cleaned text has no line breaks left: what follows a keyword up to a semicolon, up to
    # the end, or up to the end without a semicolon.
    by_pattern = F.concat(
        *[
            F.regexp_extract_all("cleaned", F.lit(rf"(?is)\b({STATEMENT_KEYWORDS})\b{rest}"), F.lit(0))
            for rest in (".*?;", ".*", "[^;]*$")
        ]
    )
    marked = lambda p: F.struct(p.alias("text"), valid_sql(p).alias("valid"))
    pieces = (
        files.withColumn("parts", F.filter(F.transform(parts, strip), lambda p: p != ""))
        .withColumn("parts", F.transform("parts", marked))
        .withColumn("is_cut", F.size(F.filter("parts", lambda p: p["valid"])) > 1)
        .withColumn("cleaned", F.when(~F.col("is_cut"), clean_text("content")))
        .select(
            "file_path",
            "is_cut",
            F.posexplode(F.when(F.col("is_cut"), F.col("parts")).otherwise(F.transform(by_pattern, marked))).alias("pos", "part"),
        )
    )
    # one shuffle by file serves the line numbers and the removal of repeats
    before = Window.partitionBy("file_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("is_cut"), occurrences(F.col("part.text"), "\n") + 2).otherwise(0)
    statements = (
        pieces.withColumn("line_number", F.coalesce(F.sum(step).over(before), F.lit(0)) + 1)
        .where("part.valid")
        .select("file_path", "pos", clean_text("part.text").alias("statement"), "line_number")
        .withColumn("__same", normalized("statement"))
    )
    first = latest_per_key(statements, ["file_path", "__same"], [("pos", True)])
    return first.select("file_path", "statement", "line_number", confidence("statement").alias("confidence"))


def dedup_statements(statements: DataFrame, text: str, order: str) -> DataFrame:
    """The first statement of each normalized text, over the whole corpus."""
    keyed = statements.withColumn("__same", normalized(text))
    return latest_per_key(keyed, ["__same"], [(order, True)]).drop("__same")


# --- features ----------------------------------------------------------------------


def dialect_by_functions(text: str | Column) -> Column:
    """Dialect by the functions a statement uses; ``spark`` if none is typical."""
    lower = F.lower(_col(text))
    out = F
    for name, marks in DIALECT_MARKS:
        out = out.when(has(lower, *marks), F.lit(name))
    return out.otherwise("spark")


def dialect_by_syntax(text: str | Column) -> Column:
    """Dialect by casts, pseudo tables and brackets; ``standard`` if none occurs."""
    body = _col(text)
    lower = F.lower(body)
    return (
        F.when(has(body, "::") & has(lower, "interval", "now()"), "postgres")
        .when(has(lower, "dual", "sysdate"), "oracle")
        .when(has(lower, "getdate()") | has(body, "["), "sqlserver")
        .otherwise("standard")
    )


def complexity(text: str | Column) -> Column:
    """1 for a select, 2 per join, 3 for a nested select, 2 per CASE WHEN, 2 per OVER."""
    lower = F.lower(_col(text))
    return (
        F.when(has(lower, "select"), 1).otherwise(0)
        + occurrences(lower, "join") * 2
        # the pattern is greedy over the whole text, so nesting counts at most once
        + F.when(lower.rlike(r"(?s)\(.*select.*\)"), 3).otherwise(0)
        + matches(lower, r"case\s+when") * 2
        + matches(lower, r"over\s*\(") * 2
    )


def complexity_by_keywords(text: str | Column) -> Column:
    """2 per JOIN, 1 per CASE, 1 per SUBSTRING, 3 per short-form cast."""
    body = _col(text)
    return (
        matches(body, r"(?i)\bJOIN\b") * 2
        + matches(body, r"(?i)\bCASE\b")
        + matches(body, r"(?i)\bSUBSTRING\b")
        + matches(body, r"(?i)::bit|::int|::text") * 3
    )


def tables_of(text: str | Column) -> Column:
    """Distinct table names after FROM or JOIN."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(TABLE_NAME), F.lit(1)))


def schemas_of(text: str | Column) -> Column:
    """Distinct schema names: what stands before a dot, or a whole tenant schema."""
    found = F.regexp_extract_all(_col(text), F.lit(SCHEMA_NAME), F.lit(1))
    return F.array_distinct(F.transform(found, lambda s: F.substring_index(s, ".", 1)))


def tenants_of(text: str | Column) -> Column:
    """Tenant numbers in names like app_db_eu_42_main."""
    return F.regexp_extract_all(_col(text), F.lit(TENANT_SCHEMA), F.lit(1))


def table_index(statements: DataFrame, key: str, text: str) -> DataFrame:
    """(table_name, key): which statement uses which table."""
    return statements.select(F.explode(tables_of(text)).alias("table_name"), key)


def tenant_rollup(statements: DataFrame, text: str) -> DataFrame:
    """Per tenant: statements, and those that touch several tenants."""
    per_statement = statements.select(tenants_of(text).alias("tenants"))
    exploded = per_statement.select(
        (F.size("tenants") > 1).alias("shared"), F.explode(F.array_distinct("tenants")).alias("tenant")
    )
    return exploded.groupBy("tenant").agg(
        F.count(F.lit(1)).alias("n_statements"), F.count(F.when(F.col("shared"), 1)).alias("n_shared")
    )


def constructs(text: str | Column) -> dict[str, Column]:
    """Counts of the constructs of a statement, by pattern."""
    lower = F.lower(_col(text))
    ctes = F.when(lower.rlike(r"^\s*with\b"), matches(lower, r"\bas\s*\(\s*select\b")).otherwise(0)
    return {
        "n_cte": ctes,
        "n_window": matches(lower, r"\bover\s*\("),
        "n_subquery": matches(lower, r"\(\s*select\b") - ctes,
        "n_join": matches(lower, r"\bjoin\b"),
        "n_case": matches(lower, r"\bcase\b"),
        "n_aggregate": matches(lower, r"\b(?:count|sum|avg|min|max|string_agg|array_agg)\s*\("),
    }


def lint_rules(text: str | Column) -> dict[str, Column]:
    """Rule name → whether the statement breaks it."""
    body = _col(text)
    lower = F.lower(body)
    joins = occurrences(lower, "join")
    return {
        "select_star": has(lower, "select *"),
        "several_joins": joins > 3,
        "many_joins": joins > 5,
        "some_join": (joins > 0) & (joins <= 3),
        "no_where": has(lower, "select") & ~has(lower, "where"),
        "order_without_limit": has(lower, "order by") & ~has(lower, "limit"),
        "distinct": has(lower, "distinct"),
        "multi_tenant": body.rlike(TENANT_SCHEMA),
        "unbalanced_parentheses": occurrences(body, "(") != occurrences(body, ")"),
        "open_string": occurrences(body, "'") % 2 != 0,
    }


# Rules that count as opportunities in the workspace summary (fixed values).
OPPORTUNITIES = ("select_star", "several_joins", "no_where", "multi_tenant")


def findings(df: DataFrame, keys: list[str], rules: dict[str, Column], out: str = "rule") -> DataFrame:
    """(keys, rule) for every rule that holds; rows without a finding vanish."""
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    # a plain explode would let the optimizer filter by ``hits`` first and copy what it rests on
    return spread(df).select(*keys, F.explode_outer(hits).alias(out)).where(F.col(out).isNotNull())


def workspace_files(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per SQL file: opportunities, complexity, tenant flag, dialect."""
    rules = lint_rules(text)
    n = sum(F.when(rules[name], 1).otherwise(0) for name in OPPORTUNITIES)
    sql_only = df.where(has(F.lower(text), *SQL_WORDS))
    return sql_only.select(
        *keys,
        n.alias("opportunities"),
        complexity(text).alias("complexity"),
        rules["multi_tenant"].alias("multi_tenant"),
        dialect_by_syntax(text).alias("dialect"),
    )


def workspace_totals(files: DataFrame) -> DataFrame:
    """One row: SQL files, opportunities, multi-tenant and highly complex files."""
    return files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("opportunities").alias("opportunities"),
        F.count(F.when(F.col("multi_tenant"), 1)).alias("multi_tenant"),
        F.count(F.when(F.col("complexity") > 7, 1)).alias("high_complexity"),
        F.least(F.sum("opportunities") * 5, F.lit(50)).alias("improvement_percent"),
    )
