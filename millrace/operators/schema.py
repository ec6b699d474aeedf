"""Schema inference, partition-key candidates, schema comparison and evolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.operators.expressions import lenient_cast
from millrace.session import materialize, spread

# Name parts that mark a likely partition column (fixed values).
PARTITION_NAME_PARTS = ("year", "month", "day", "date", "partition", "bucket", "region")
PARTITION_NAME = "|".join(PARTITION_NAME_PARTS)
MIN_ROWS = 10
MAX_DISTINCT_SHARE = 0.2

# Default value of a new column, per type name (fixed values; other types start as null).
TYPE_DEFAULTS = {
    "string": "",
    "bigint": 0,
    "int": 0,
    "double": 0.0,
    "float": 0.0,
    "boolean": False,
}


def type_name(value: Column, kind: Column) -> Column:
    """Hive type name of one JSON value and the kind of its variant; null for null."""
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    is_day = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    scalar = (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "bigint")
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL") | (kind == "FLOAT"), "double")
        .when(kind.startswith("OBJECT"), "struct<>")
        .when((kind == "STRING") & is_day & text.rlike("[T ]"), "timestamp")
        .when((kind == "STRING") & is_day, "date")
        .otherwise("string")
    )
    return F.when(kind.startswith("ARRAY"), F.lit(None).cast("string")).otherwise(scalar)


def infer_fields(df: DataFrame, column: str) -> DataFrame:
    """(field, type) over all JSON records of ``column``.

    Each record's fields vote by type; nulls do not vote. One type wins if it is the only
    one, else the field is a string. Types are counted per (field, type) with map-side
    combine, so a field that occurs in every record is no bottleneck.
    """
    spark = df.sparkSession
    parsed = spread(df.select(column)).select(F.try_parse_json(F.col(column)).alias("doc"))
    parsed = parsed.where("doc IS NOT NULL")
    fields = spark.sql(
        "SELECT f.key AS field, f.value AS value FROM {docs}, LATERAL variant_explode(doc) AS f",
        docs=parsed,
    )
    value, first = F.col("value"), F.col("first")
    fields = fields.withColumn("kind", F.schema_of_variant("value"))
    is_list = F.col("kind").startswith("ARRAY")
    fields = fields.withColumn("first", F.when(is_list, F.try_variant_get("value", "$[0]", "variant")))
    element = F.coalesce(type_name(first, F.schema_of_variant("first")), F.lit("string"))
    kind = F.when(is_list, F.concat(F.lit("array<"), element, F.lit(">"))).otherwise(
        type_name(value, F.col("kind"))
    )
    votes = fields.select("field", kind.alias("type")).groupBy("field", "type").count()
    return votes.groupBy("field").agg(
        F.when(F.count("type") == 1, F.max("type")).otherwise("string").alias("type")
    )


def name_marks_partition(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(column).rlike(PARTITION_NAME)


def partition_candidates(df: DataFrame, margin: float = 0.1) -> DataFrame:
    """(field, by_name, by_values): columns that could serve as partition keys."""
    return column_profile({"": df}, margin).select("field", "by_name", "by_values")


def column_profile(tables: dict[str, DataFrame], margin: float = 0.1) -> DataFrame:
    """(table_name, field, type, n_rows, by_name, by_values), one row per column of all tables.

    One plan estimates the distinct values of every column of every table by a sketch with
    1.6 % standard error; columns whose share lies within ``margin`` (six such errors) of the
    limit are counted exactly in a second plan. Only the names of those reach the driver.
    """
    found = materialize(union_fields([_sketched(name, df) for name, df in tables.items()]), "sketches")
    limit = F.col("n_rows") * MAX_DISTINCT_SHARE
    near = found.where(F.abs(F.col("n_values") - limit) <= limit * margin).select("table_name", "field").collect()
    if near:
        exact = [
            tables[r.table_name].agg(F.count_distinct(f"`{r.field}`").alias("exact")).select(
                F.lit(r.table_name).alias("table_name"), F.lit(r.field).alias("field"), "exact"
            )
            for r in near
        ]
        exact = F.broadcast(union_fields(exact))  # a row per column
        found = found.join(exact, ["table_name", "field"], "left")
        found = found.withColumn("n_values", F.coalesce("exact", "n_values"))
    few = F.try_divide("n_values", "n_rows") < MAX_DISTINCT_SHARE
    return found.select(
        "table_name",
        "field",
        "type",
        "n_rows",
        name_marks_partition("field").alias("by_name"),
        ((F.col("n_rows") > MIN_ROWS) & few).alias("by_values"),
    )


def _sketched(name: str, df: DataFrame) -> DataFrame:
    """(table_name, n_rows, field, type, n_values) of one table in one pass; ``n_values`` is an estimate."""

    def values(column: str) -> Column:
        hashed = F.when(F.col(f"`{column}`").isNotNull(), F.xxhash64(f"`{column}`"))
        return F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(12)))

    packed = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            F.struct(F.lit(f.name).alias("field"), F.lit(hive_type(f.dataType)).alias("type"), values(f.name).alias("n_values")).alias(f"s{i}")
            for i, f in enumerate(df.schema.fields)
        ],
    )
    one = F.explode(F.array(*[f"s{i}" for i in range(len(df.columns))])).alias("s")
    return packed.select("n_rows", one).select(F.lit(name).alias("table_name"), "n_rows", "s.*")


def hive_type(data_type) -> str:
    """Type name used in the reports: zone-less times count as timestamp."""
    return data_type.simpleString().replace("timestamp_ntz", "timestamp")


def table_fields(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, field, type, is_partition, n_rows), one row per column of all tables."""
    either = (F.col("by_name") | F.col("by_values")).alias("is_partition")
    return column_profile(tables).select("table_name", "field", "type", either, "n_rows")


def schema_statistics(fields: DataFrame) -> DataFrame:
    """Per table: columns, partition columns, columns per type and the four warnings."""
    data = ~F.col("is_partition")

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    nested = F.col("type").rlike("struct|array")
    per_table = fields.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_fields"),
        count(data).alias("data_columns"),
        count(~data).alias("partition_columns"),
        F.max("n_rows").alias("n_rows"),
        count(F.col("type") == "string").alias("n_string"),
        count(F.col("type") == "bigint").alias("n_bigint"),
        count(F.col("type") == "int").alias("n_int"),
        count(F.col("type") == "double").alias("n_double"),
        count(F.col("type") == "timestamp").alias("n_timestamp"),
        count(data & nested).alias("__nested"),
        count(data & (F.col("type") == "string")).alias("__strings"),
    )
    return per_table.select(
        *[c for c in per_table.columns if not c.startswith("__")],
        (F.col("data_columns") > 50).alias("wide"),
        ((F.col("partition_columns") == 0) & (F.col("n_rows") > 1000)).alias("needs_partition"),
        (F.col("__nested") > 0).alias("nested"),
        (F.col("__strings") > F.col("data_columns") * 0.8).alias("mostly_strings"),
    )


def diff_columns(old: DataFrame, new: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(table_name, column_name, old_type, new_type, change) between two catalog snapshots.

    Snapshots have (table_name, column_name, type), so thousands of tables are compared
    by one full outer join.
    """
    name = F.col("column_name") if case_sensitive else F.lower("column_name")
    left = old.select("table_name", name.alias("column_name"), F.col("type").alias("old_type"))
    right = new.select("table_name", name.alias("column_name"), F.col("type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "modified")
        .otherwise("unchanged")
    )
    joined = left.join(right, ["table_name", "column_name"], "full")
    return joined.withColumn("change", change)


def diff_summary(changes: DataFrame) -> DataFrame:
    """Per table: counts of each change, compatibility flags and the two warnings."""

    def count(kind: str) -> Column:
        return F.count(F.when(F.col("change") == kind, 1))

    to_number = F.col("old_type").contains("string") & F.col("new_type").contains("int")
    per_table = changes.groupBy("table_name").agg(
        count("added").alias("added"),
        count("removed").alias("removed"),
        count("modified").alias("modified"),
        count("unchanged").alias("unchanged"),
        F.count(F.when((F.col("change") == "modified") & to_number, 1)).alias("__numbers"),
    )
    return per_table.select(
        "table_name",
        "added",
        "removed",
        "modified",
        "unchanged",
        (F.col("added") + F.col("removed") + F.col("modified") > 0).alias("changes_detected"),
        ((F.col("removed") == 0) & (F.col("modified") == 0)).alias("backward_compatible"),
        (F.col("modified") > 0).alias("migration_required"),
        (F.col("added") > 10).alias("many_added"),
        (F.col("__numbers") > 0).alias("string_to_number"),
    )


class SchemaMismatch(ValueError):
    """Data and wanted schema differ and the mode forbids it."""


def default_of(type_text: str) -> Column:
    """Start value of a new column."""
    if type_text.startswith("array"):
        return F.array().cast(type_text)
    return F.lit(TYPE_DEFAULTS.get(type_text)).cast(type_text)


def evolve(df: DataFrame, wanted: str | StructType, mode: str = "merge", case_sensitive: bool = False) -> DataFrame:
    """Bring a table to a new schema in one projection.

    ``merge`` adds missing columns with the default of their type, casts changed ones (a
    value that does not fit becomes null) and keeps columns the new schema lacks;
    ``overwrite`` also drops those; ``fail`` raises if anything differs.
    """
    wanted = StructType.fromDDL(wanted) if isinstance(wanted, str) else wanted
    fold = (lambda s: s) if case_sensitive else str.lower
    have = {fold(f.name): f for f in df.schema.fields}
    goal = {fold(f.name): f for f in wanted.fields}
    if mode == "fail":
        same = have.keys() == goal.keys() and all(
            have[k].dataType == goal[k].dataType for k in goal
        )
        if not same:
            raise SchemaMismatch("the data does not have the wanted schema")
        return df
    if mode not in ("merge", "overwrite"):
        raise ValueError(f"unknown evolution mode: {mode}")

    def target(key: str) -> Column:
        field = goal[key]
        if key not in have:
            return default_of(field.dataType.simpleString()).alias(field.name)
        column = F.col(f"`{have[key].name}`")
        if have[key].dataType != field.dataType:
            column = lenient_cast(column, field.dataType.simpleString())
        return column.alias(field.name)

    columns = [target(k) for k in goal]
    if mode == "merge":
        columns += [F.col(f"`{f.name}`") for k, f in have.items() if k not in goal]
    return df.select(*columns)


def failed_casts(df: DataFrame, wanted: str | StructType) -> DataFrame:
    """(field, failed): values per changed column that the new type cannot hold."""
    wanted = StructType.fromDDL(wanted) if isinstance(wanted, str) else wanted
    have = {f.name.lower(): f for f in df.schema.fields}
    changed = [
        (have[f.name.lower()].name, f)
        for f in wanted.fields
        if f.name.lower() in have and have[f.name.lower()].dataType != f.dataType
    ]
    counts = df.agg(
        *[
            F.count(F.when(F.col(old).isNotNull() & lenient_cast(F.col(old), f.dataType.simpleString()).isNull(), 1)).alias(f.name)
            for old, f in changed
        ]
    )
    return counts.unpivot([], [f.name for _, f in changed], "field", "failed")


def register_table(
    spark: SparkSession,
    table: str,
    columns: list[tuple[str, str, str]],
    partitions: list[tuple[str, str, str]],
    location: str,
    fmt: str = "parquet",
) -> str:
    """Create an external table over files that already lie at ``location``.

    ``columns`` and ``partitions`` are (name, type, comment); partitions found in the
    folder names are added to the catalog.
    """

    def line(name: str, kind: str, comment: str) -> str:
        escaped = comment.replace("'", "\\'")
        return f"`{name}` {kind}" + (f" COMMENT '{escaped}'" if comment else "")

    ddl = f"CREATE TABLE {table} ({', '.join(line(*c) for c in columns + partitions)}) USING {fmt}"
    if partitions:
        ddl += f" PARTITIONED BY ({', '.join(name for name, _, _ in partitions)})"
    spark.sql(f"{ddl} LOCATION '{location}'")
    if partitions:
        spark.sql(f"MSCK REPAIR TABLE {table}")
    return table


def add_columns(spark: SparkSession, table: str, columns: list[tuple[str, str]]) -> None:
    listed = ", ".join(f"`{name}` {kind}" for name, kind in columns)
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({listed})")


def union_fields(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
