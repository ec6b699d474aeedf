"""Line rules over job files: review findings, per-file metrics, code inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.corpus import has
from millrace.session import spread

# --- fixed values: (rule, category, severity, pattern; case is ignored) -------------

LINE_RULES = (
    ("unsupported_functions", "aws_glue", "warning", r"\b(collect|toPandas|foreach|foreachPartition)\s*\("),
    ("missing_glue_context", "aws_glue", "warning", r"SparkSession\.builder"),
    ("hardcoded_paths", "aws_glue", "warning", r"['\"]s3://[^'\"]*['\"]"),
    ("expensive_operations", "performance", "error", r"\.(count|collect|show)\(\)"),
    ("missing_cache", "performance", "warning", r"\.groupBy\(.*\)\.agg\("),
    ("inefficient_joins", "performance", "warning", r"\.join\("),
    ("select_star", "performance", "warning", r"\.select\(\s*\*\s*\)"),
    ("missing_error_handling", "best_practice", "info", r"spark\.read\."),
    ("missing_schema", "best_practice", "info", r"\.option\(['\"]inferSchema['\"],\s*['\"]true['\"]"),
    ("inefficient_file_format", "best_practice", "info", r"\.(csv|json)\("),
)
MAX_LINE = 88
PYSPARK_MARKS = (
    "from pyspark", "import pyspark", "SparkSession", "spark.sql", "spark.table",
    "DataFrame", ".show()", ".collect()", ".write.",
)
PATTERN_TAGS = (
    ("joins", (".join(",)),
    ("aggregations", (".groupBy(",)),
    ("filtering", (".filter(", ".where(")),
    ("projections", (".select(",)),
    ("sorting", (".orderBy(",)),
)


def line_checks(line: Column, after: Column) -> list[tuple[str, str, str, Column]]:
    """(rule, category, severity, condition) of every check on a line and the one after it."""
    checks = [(rule, cat, sev, line.rlike(f"(?i){p}")) for rule, cat, sev, p in LINE_RULES]
    undocumented = line.rlike(r"^\s*def\s+\w+") & after.isNotNull() & ~after.rlike(r"^\s*['\"]{3}")
    checks.append(("long_line", "style", "info", F.length(line) > MAX_LINE))
    checks.append(("missing_docstring", "style", "info", undocumented))
    return checks


def file_checks(text: Column) -> list[tuple[str, str, str, Column]]:
    """(rule, category, severity, condition) of every check on a whole file."""
    return [
        ("missing_glue_imports", "aws_glue", "info", ~has(text, "from awsglue", "GlueContext")),
        ("missing_job_commit", "aws_glue", "warning", ~text.rlike(r"(?i)job\.commit\(\)")),
    ]


def _line_pairs(content: str) -> Column:
    """Lines with the line after each, null after the last.

    The next line is taken from the same array, so no window has to order the lines.
    """
    lines = F.split(F.col(content), "\n", -1)
    following = F.slice(lines, F.lit(2), F.size(lines))
    return F.arrays_zip(lines.alias("line"), following.alias("next_line"))


def review_findings(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, line_number, rule, category, severity); file-level findings have line 0."""

    def hits(checks: list) -> Column:
        found = [
            F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(cat).alias("category"), F.lit(sev).alias("severity")))
            for rule, cat, sev, cond in checks
        ]
        return F.explode(F.array_compact(F.array(*found))).alias("f")

    files = spread(files)
    lines = files.select(*keys, F.posexplode(_line_pairs(content)).alias("pos", "pair")).select(
        *keys, (F.col("pos") + 1).alias("line_number"), "pair.line", "pair.next_line"
    )
    by_line = lines.select(*keys, "line_number", hits(line_checks(F.col("line"), F.col("next_line"))))
    by_file = files.select(*keys, F.lit(0).alias("line_number"), hits(file_checks(F.col(content))))
    return by_line.unionByName(by_file).select(*keys, "line_number", "f.*")


def review_metrics(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Per file: lines, and findings in total, by severity and by category.

    Counted inside each row, so nothing is shuffled.
    """
    files = spread(files).withColumn("__pairs", _line_pairs(content))

    def lines_with(check: int) -> Column:
        return F.size(F.filter("__pairs", lambda p: line_checks(p["line"], p["next_line"])[check][3]))

    kinds_of_checks = line_checks(F.lit(""), F.lit(""))
    counts = [(cat, sev, lines_with(i)) for i, (_, cat, sev, _) in enumerate(kinds_of_checks)]
    counts += [(cat, sev, F.when(cond, 1).otherwise(0)) for _, cat, sev, cond in file_checks(F.col(content))]
    counted = files.select(
        *keys, F.size("__pairs").alias("lines"), *[c.alias(f"__c{i}") for i, (_, _, c) in enumerate(counts)]
    )

    def total(kind: str | None) -> Column:
        picked = [F.col(f"__c{i}") for i, (cat, sev, _) in enumerate(counts) if kind in (None, cat, sev)]
        return sum(picked[1:], picked[0]).cast("bigint")

    kinds = ("error", "warning", "info", "aws_glue", "performance", "best_practice", "style")
    return counted.select(*keys, "lines", total(None).alias("issues"), *[total(k).alias(f"n_{k}") for k in kinds])


def file_inventory(files: DataFrame, keys: list[str], path: str = "file_path", content: str = "content") -> DataFrame:
    """Per file: kind, PySpark use, pattern tags, sources read, issue and violation counts."""
    text = F.col(content)
    n_lines = lambda cond: F.size(F.filter(F.split(text, "\n", -1), cond))
    tags = [
        F.when(has(text, *marks), F.lit(tag)) for tag, marks in PATTERN_TAGS
    ]
    is_python = F.col(path).endswith(".py")
    first = lambda tag: F.locate(tag, text)
    filter_at = F.least(
        F.when(first(".filter(") > 0, first(".filter(")), F.when(first(".where(") > 0, first(".where("))
    )
    sources = F.concat(
        F.regexp_extract_all(text, F.lit(r"spark\.read[^\n]*\.(?:parquet|csv)\([\"']([^\"']+)[\"']"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"spark\.table\([\"']([^\"']+)[\"']"), F.lit(1)),
    )
    return files.select(
        *keys,
        F.when(is_python, "python").when(F.col(path).endswith(".sql"), "sql").otherwise("other").alias("kind"),
        (is_python & has(text, *PYSPARK_MARKS)).alias("is_pyspark"),
        F.array_compact(F.array(*tags)).alias("tags"),
        sources.alias("sources"),
        (
            n_lines(lambda l: F.contains(l, F.lit(".collect()")))
            + F.when(has(text, ".cache()"), 0).otherwise(n_lines(lambda l: F.contains(l, F.lit(".count()"))))
            + n_lines(lambda l: F.contains(l, F.lit("spark.sql(")) & (F.length(F.trim(l)) > 100))
        ).alias("n_performance"),
        (
            n_lines(lambda l: F.contains(l, F.lit("spark.createDataFrame(")))
            + n_lines(lambda l: F.contains(l, F.lit(".repartition(1)")))
            + F.when(has(text, "SparkSession.builder") & ~has(text, "spark.stop()"), 1).otherwise(0)
        ).alias("n_violations"),
        (has(text, ".join(") & ~has(F.lower(text), "broadcast")).alias("use_broadcast"),
        (has(text, ".groupBy(") & ~has(F.lower(text), "cache")).alias("use_cache"),
        F.coalesce((filter_at > first(".select(")) & (first(".select(") > 0), F.lit(False)).alias("filter_earlier"),
    )


def codebase_totals(inventory: DataFrame) -> DataFrame:
    """One row: files by kind, files per tag, and the totals of the checks."""

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    pyspark = F.col("is_pyspark")
    return inventory.agg(
        F.count(F.lit(1)).alias("n_files"),
        count(pyspark).alias("n_pyspark"),
        count(F.col("kind") == "sql").alias("n_sql"),
        *[
            count(pyspark & F.array_contains("tags", tag)).alias(f"n_{tag}") for tag, _ in PATTERN_TAGS
        ],
        F.sum(F.when(pyspark, F.size("sources")).otherwise(0)).alias("n_sources"),
        F.sum(F.when(pyspark, F.col("n_performance")).otherwise(0)).alias("n_performance"),
        F.sum(F.when(pyspark, F.col("n_violations")).otherwise(0)).alias("n_violations"),
        count(pyspark & F.col("use_broadcast")).alias("n_use_broadcast"),
        count(pyspark & F.col("use_cache")).alias("n_use_cache"),
        count(pyspark & F.col("filter_earlier")).alias("n_filter_earlier"),
    )
