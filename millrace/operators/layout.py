"""File layout: inventory, small files, compaction, format change, partition choice, statistics."""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from millrace.session import path_exists
from millrace.sources.files import read_table, write_table

MB = 1024 * 1024
TARGET_FILE_MB = 128
MAX_FILES = 1000

# Order in which a path is tested for its format (fixed values).
FORMAT_MARKS = (
    (".parquet", "parquet"),
    (".csv", "csv"),
    (".json", "json"),
    (".orc", "orc"),
    (".avro", "avro"),
    ("_delta_log", "delta"),
)
PARTITION_PAIR = r"([A-Za-z_][A-Za-z0-9_]*)=([^/]+)"
DATE_WORDS = "date|timestamp"
PLACE_WORDS = "region|country"
DATE_COLUMN = r"(\w*(?:date|time|year|month)\w*)"


# --- files -------------------------------------------------------------------------


def file_inventory(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modified) of every file below ``path``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def format_of(path: str | Column) -> Column:
    """Format named by a path: the first mark found in it, else ``unknown``."""
    text = F.lower(F.col(path) if isinstance(path, str) else path)
    out = F
    for mark, name in FORMAT_MARKS:
        out = out.when(F.contains(text, F.lit(mark)), F.lit(name))
    return out.otherwise("unknown")


def folder_of(path: str | Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def partition_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """(key, n_values, n_files): partition keys found as key=value in the paths.

    Files are counted per folder before the pairs are taken apart, so the work after the
    first aggregate depends on the number of folders only.
    """
    folders = files.groupBy(folder_of(path).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    pairs = folders.select(
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("folder", F.lit(PARTITION_PAIR), F.lit(1)).alias("key"),
                F.regexp_extract_all("folder", F.lit(PARTITION_PAIR), F.lit(2)).alias("value"),
            )
        ).alias("pair"),
        "n",
    )
    return pairs.groupBy(F.col("pair.key").alias("key")).agg(
        F.countDistinct("pair.value").alias("n_values"), F.sum("n").alias("n_files")
    )


def location_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row for a location: files, size, formats, last change, Delta or not."""
    files = file_inventory(spark, path)
    return files.agg(
        F.lit(path).alias("location"),
        F.count(F.lit(1)).alias("n_files"),
        (F.sum("length") / MB).alias("size_mb"),
        F.array_sort(F.collect_set(format_of("path"))).alias("formats"),
        F.max("modified").alias("last_modified"),
        F.lit(path_exists(spark, f"{path}/_delta_log")).alias("is_delta"),
    )


def small_file_report(
    files: DataFrame, target_mb: float = TARGET_FILE_MB, max_files: int = MAX_FILES
) -> DataFrame:
    """Per folder: files, bytes, mean size, files below the target, files wanted, too many."""
    target = int(target_mb * MB)
    return files.groupBy(folder_of("path").alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("length").cast("bigint").alias("bytes"),
        (F.sum("length") / F.count(F.lit(1))).alias("mean_bytes"),
        F.count(F.when(F.col("length") < target, 1)).alias("n_small"),
        F.ceil(F.sum("length") / F.lit(target)).cast("bigint").alias("n_wanted"),
        (F.count(F.lit(1)) > max_files).alias("too_many"),
    )


def total_bytes(spark: SparkSession, path: str) -> int:
    return file_inventory(spark, path).agg(F.sum("length")).first()[0] or 0


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _fingerprint(df: DataFrame) -> list[Column]:
    """Row count and a sum of row hashes, which do not depend on the order of rows."""
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("rows"), F.sum(row).alias("hash")]


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    strategy: str = "coalesce",
    target_mb: float = TARGET_FILE_MB,
    partition_by: list[str] | None = None,
    fmt: str = "parquet",
) -> dict:
    """Rewrite ``source`` into files of about ``target_mb`` at the new path ``target``.

    ``coalesce`` merges input splits without a shuffle; ``repartition`` spreads rows evenly
    or, with partition columns, rebalances by them: Spark cuts a large partition value into
    several tasks of the target size and merges small ones. Count and hash of the rows are
    observed during the write and compared with the files that landed.
    """
    df = read_table(spark, source, fmt)
    wanted = max(1, math.ceil(total_bytes(spark, source) / (target_mb * MB)))
    if strategy == "coalesce":
        out = df.coalesce(wanted)
    elif strategy != "repartition":
        raise ValueError(f"unknown strategy: {strategy}")
    elif partition_by:
        out = df.hint("rebalance", wanted, *[F.col(c) for c in partition_by])
    else:
        out = df.repartition(wanted)
    seen = Observation()
    out = out.observe(seen, *_fingerprint(df))
    with _setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(int(target_mb * MB))):
        write_table(out, target, fmt, partition_by=partition_by)
    back = read_table(spark, target, fmt, schema=df.schema)
    landed = back.agg(*_fingerprint(back)).first().asDict()
    written = dict(seen.get)
    if landed != written:
        raise RuntimeError(f"{target}: wrote {written} but found {landed}")
    return {"files_wanted": wanted, **written}


def convert_format(
    spark: SparkSession,
    source: str,
    source_format: str,
    target: str,
    target_format: str = "parquet",
    codec: str | None = None,
    schema=None,
) -> str:
    df = read_table(spark, source, source_format, schema=schema)
    return write_table(df, target, target_format, codec=codec)


# --- findings over a table of tables -----------------------------------------------


def layout_findings(tables: DataFrame) -> DataFrame:
    """Issues and priority per table.

    Input columns: table_name, format, size_gb, partition_levels, has_date_key,
    queried_by_date. All rules are column expressions, so one pass covers any number of
    tables.
    """
    rules = {
        "not_partitioned": F.col("partition_levels") == 0,
        "over_partitioned": F.col("partition_levels") > 3,
        "text_format": F.col("format").isin("csv", "json"),
        "very_large": F.col("size_gb") > 100,
        "small_files": F.col("size_gb") < 10,
        "date_key_missing": F.col("queried_by_date") & ~F.col("has_date_key"),
    }
    flagged = tables.select("*", *[rule.alias(name) for name, rule in rules.items()])
    # the date key is a recommendation and does not count as an issue
    n_issues = sum(F.col(name).cast("int") for name in rules if name != "date_key_missing")
    level = (
        F.when(n_issues >= 5, "HIGH").when(n_issues >= 3, "MEDIUM").when(n_issues >= 1, "LOW").otherwise("NONE")
    )
    return flagged.select(
        "table_name", *rules, n_issues.cast("int").alias("n_issues"), level.alias("priority")
    )


def portfolio_advice(tables: DataFrame) -> DataFrame:
    """One row of advice switches over all tables: size, formats, partitions."""

    def any_(cond: Column) -> Column:
        return F.coalesce(F.bool_or(cond), F.lit(False))

    return tables.agg(
        (F.sum(F.col("size_gb").cast("decimal(18,6)")) * 1024 > 10000).alias("large_estate"),
        any_(F.col("format") == "csv").alias("convert_csv"),
        any_(F.col("format") == "delta").alias("use_delta_features"),
        any_(F.col("partition_levels") > 0).alias("use_pruning"),
    )


def partition_advice_from_log(log: DataFrame) -> DataFrame:
    """Per table of a query log (table_name, sql): statements that name dates or places."""
    text = F.lower("sql")
    dates, places = text.rlike(DATE_WORDS), text.rlike(PLACE_WORDS)
    counts = log.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count(F.when(dates, 1)).alias("n_date"),
        F.count(F.when(places, 1)).alias("n_place"),
    )
    return counts.select(
        "*", (F.col("n_date") > 0).alias("by_date"), (F.col("n_place") > 0).alias("by_place")
    )


def column_usage(log: DataFrame) -> DataFrame:
    """(table_name, column_name, role, uses): date-like filter columns and join keys."""
    text = F.lower("sql")
    filters = F.regexp_extract_all(
        F.regexp_extract(text, r"\bwhere\b(.*)", 1), F.lit(DATE_COLUMN), F.lit(1)
    )
    joins = F.regexp_extract_all(text, F.lit(r"\bon\s+\w+\.(\w+)\s*="), F.lit(1))

    def used(found: Column, role: str) -> Column:
        return F.transform(
            found, lambda c: F.struct(c.alias("column_name"), F.lit(role).alias("role"))
        )

    uses = log.select(
        "table_name", F.explode(F.concat(used(filters, "filter"), used(joins, "join"))).alias("use")
    )
    return uses.groupBy("table_name", "use.column_name", "use.role").agg(
        F.count(F.lit(1)).alias("uses")
    )


def choose_partition_column(usage: DataFrame, sizes: DataFrame) -> DataFrame:
    """Best partition column per table, its kind, and how many partitions.

    Date-like columns go first, then filters before join keys, then the more used. Range
    partitions for a date, hash otherwise; size_mb / 100 partitions within 10 and 200.
    """
    datelike = F.col("column_name").rlike("date|time|year|month")
    best = F.min_by(
        "column_name",
        F.struct(~datelike, F.col("role") != "filter", -F.col("uses"), F.col("column_name")),
    )
    picked = usage.groupBy("table_name").agg(best.alias("column_name"))
    parts = F.least(F.lit(200), F.greatest(F.lit(10), F.floor(F.col("size_mb") / 100)))
    return picked.join(sizes, "table_name").select(
        "table_name",
        "column_name",
        F.when(F.col("column_name").contains("date"), "range").otherwise("hash").alias("kind"),
        parts.cast("bigint").alias("n_partitions"),
    )


def partition_profile(df: DataFrame, key: str) -> DataFrame:
    """Rows per value of a key, with its share of all rows and the skew against the mean."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    one = counts.agg(F.struct(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_values"))).scalar()
    joined = counts.withColumn("__all", one)
    return joined.select(
        key,
        "n_rows",
        F.col("__all.n_values").alias("n_values"),
        (F.col("n_rows") / F.col("__all.n_rows")).alias("share"),
        (F.col("n_rows") * F.col("__all.n_values") / F.col("__all.n_rows")).alias("skew"),
    )


# --- statistics --------------------------------------------------------------------


def column_stats(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """(table_name, column_name, n_rows, n_nulls, low, high), all columns in one pass."""
    columns = columns or df.columns
    packed = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.when(F.col(c).isNull(), 1)).alias("n_nulls"),
                F.min(c).cast("string").alias("low"),
                F.max(c).cast("string").alias("high"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ],
    )
    stats = F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")
    return packed.select("n_rows", stats).select(F.lit(name).alias("table_name"), "n_rows", "s.*")


def table_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, size_mb, n_rows) of all tables in one plan: sizes from the listing, rows from the footers."""

    def measured(name: str, path: str) -> DataFrame:
        size = F.lit(total_bytes(spark, path) / MB).alias("size_mb")
        return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), size, "n_rows")

    return reduce(DataFrame.unionByName, [measured(name, path) for name, path in paths.items()])


def filter_selectivity(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(predicate, kept, share) of each predicate, all in one pass."""
    names = list(predicates)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.when(predicates[k], 1)).alias(f"k{i}") for i, k in enumerate(names)],
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(k).alias("predicate"), F.col(f"k{i}").alias("kept")) for i, k in enumerate(names)])
    ).alias("p")
    return counts.select("n", pairs).select("p.*", F.try_divide("p.kept", "n").alias("share"))


def agg_reduction(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups, rows, and groups per row of a key set."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("__n").alias("n_rows"),
        F.try_divide(F.count(F.lit(1)), F.sum("__n")).alias("reduction"),
    )
