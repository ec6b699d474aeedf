"""Review of code corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import review as rv
from millrace.plans.derived import CODE_CORPUS, code_corpus
from millrace.plans.registry import Tables, plan


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINES = f"""
    files AS ({CODE_CORPUS}),
    arrays AS (SELECT *, string_split(content, chr(10)) AS all_lines FROM files),
    lines AS (SELECT file_id, file_path, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS line_number,
                     unnest(all_lines[2:] || [NULL]) AS next_line FROM arrays)
"""
FINDINGS = (
    " UNION ALL ".join(
        f"SELECT file_id, CAST(line_number AS INTEGER) AS line_number, '{rule}' AS rule, '{cat}' AS category, '{sev}' AS severity "
        f"FROM lines WHERE regexp_matches(line, {_quoted('(?i)' + pattern)})"
        for rule, cat, sev, pattern in rv.LINE_RULES
    )
    + """
    UNION ALL SELECT file_id, CAST(line_number AS INTEGER), 'long_line', 'style', 'info' FROM lines WHERE length(line) > 88
    UNION ALL SELECT file_id, CAST(line_number AS INTEGER), 'missing_docstring', 'style', 'info' FROM lines
      WHERE regexp_matches(line, '^\\s*def\\s+\\w+') AND next_line IS NOT NULL AND NOT regexp_matches(next_line, '^\\s*[''"]{3}')
    UNION ALL SELECT file_id, 0, 'missing_glue_imports', 'aws_glue', 'info' FROM files
      WHERE NOT (contains(content, 'from awsglue') OR contains(content, 'GlueContext'))
    UNION ALL SELECT file_id, 0, 'missing_job_commit', 'aws_glue', 'warning' FROM files
      WHERE NOT regexp_matches(content, '(?i)job\\.commit\\(\\)')
    """
)


@plan("code_review", f"WITH {LINES} {FINDINGS}")
def code_review(t: Tables) -> DataFrame:
    return rv.review_findings(code_corpus(t), ["file_id"])


@plan(
    "review_metrics",
    f"""
    WITH {LINES}, found AS ({FINDINGS})
    SELECT file_id, CAST((SELECT COUNT(*) FROM lines l WHERE l.file_id = f.file_id) AS INTEGER) AS lines, COUNT(*) AS issues,
           COUNT(*) FILTER (severity = 'error') AS n_error, COUNT(*) FILTER (severity = 'warning') AS n_warning,
           COUNT(*) FILTER (severity = 'info') AS n_info, COUNT(*) FILTER (category = 'aws_glue') AS n_aws_glue,
           COUNT(*) FILTER (category = 'performance') AS n_performance, COUNT(*) FILTER (category = 'best_practice') AS n_best_practice,
           COUNT(*) FILTER (category = 'style') AS n_style
    FROM found f GROUP BY file_id
    """,
)
def review_metrics(t: Tables) -> DataFrame:
    return rv.review_metrics(code_corpus(t), ["file_id"])


@plan(
    "review_summary",
    f"WITH {LINES}, found AS ({FINDINGS}) SELECT category, severity, rule, COUNT(*) AS n FROM found GROUP BY 1, 2, 3",
)
def review_summary(t: Tables) -> DataFrame:
    found = rv.review_findings(code_corpus(t), ["file_id"])
    return found.groupBy("category", "severity", "rule").agg(F.count(F.lit(1)).alias("n"))


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(content, '{w}')" for w in words) + ")"


@plan(
    "codebase_inventory",
    f"""
    WITH files AS (SELECT *, {_any(rv.PYSPARK_MARKS)} AS py,
      len(regexp_extract_all(content, 'spark\\.read[^\\n]*\\.(?:parquet|csv)\\(["'']([^"'']+)["'']')) AS n_src,
      CAST((length(content) - length(replace(content, '.collect()', ''))) / 10 AS INTEGER) AS n_collect FROM ({CODE_CORPUS}))
    SELECT COUNT(*) AS n_files, COUNT(*) FILTER (py) AS n_pyspark, 0::BIGINT AS n_sql,
           {', '.join(f"COUNT(*) FILTER (py AND {_any(marks)}) AS n_{tag}" for tag, marks in rv.PATTERN_TAGS)},
           CAST(COALESCE(SUM(n_src) FILTER (py), 0) AS BIGINT) AS n_sources, CAST(COALESCE(SUM(n_collect) FILTER (py), 0) AS BIGINT) AS n_performance,
           0::BIGINT AS n_violations, COUNT(*) FILTER (py AND contains(content, '.join(')) AS n_use_broadcast,
           COUNT(*) FILTER (py AND contains(content, '.groupBy(')) AS n_use_cache, 0::BIGINT AS n_filter_earlier
    FROM files
    """,
)
def codebase_inventory(t: Tables) -> DataFrame:
    return rv.codebase_totals(rv.file_inventory(code_corpus(t), ["file_id"]))
