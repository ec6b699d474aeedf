"""Small column and frame helpers shared by the relational operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

# Type names of other dialects that Spark spells differently (fixed values).
TYPE_NAMES = {
    "numeric": "decimal",
    "integer": "int",
    "text": "string",
    "varchar": "string",
    "double precision": "double",
    "datetime": "timestamp",
}


def spark_type(name: str) -> str:
    """Spark spelling of a type name; precision and scale of decimals are kept."""
    name = name.strip().lower()
    base, bracket, rest = name.partition("(")
    base = TYPE_NAMES.get(base.strip(), base.strip())
    return base + bracket + rest if base == "decimal" else base


def cast_to(column: str | Column, type_name: str, strict: bool = True) -> Column:
    """CAST by dialect type name; with ``strict=False`` a bad value becomes null."""
    column = F.col(column) if isinstance(column, str) else column
    target = spark_type(type_name)
    return column.cast(target) if strict else lenient_cast(column, target)


# What a text must at least look like to be cast to a type.
LOOKS_LIKE = {
    "tinyint": r"^\s*[+-]?[0-9]+\s*$",
    "smallint": r"^\s*[+-]?[0-9]+\s*$",
    "int": r"^\s*[+-]?[0-9]+\s*$",
    "bigint": r"^\s*[+-]?[0-9]+\s*$",
    "decimal": r"[0-9]",
    "float": r"(?i)[0-9]|inf|nan",
    "double": r"(?i)[0-9]|inf|nan",
    "date": r"[0-9]",
    "timestamp": r"[0-9]",
    "timestamp_ntz": r"[0-9]",
    "boolean": r"(?i)^\s*(t|true|y|yes|1|f|false|n|no|0)\s*$",
}


def lenient_cast(column: Column, target: str) -> Column:
    """TRY_CAST that stays fast on dirty text.

    Spark's TRY_CAST raises and catches an error for every bad value, which costs far more
    than the cast. Texts that cannot be of the type are therefore sorted out by a pattern
    first. For columns that are not text the test is folded away when the plan is made.
    """
    pattern = LOOKS_LIKE.get(target.partition("(")[0])
    if pattern is None:
        return column.try_cast(target)
    possible = (F.typeof(column) != "string") | column.cast("string").rlike(pattern)
    return F.when(possible, column.try_cast(target))


def within(column: str, as_of: Column, amount: int, unit: str) -> Column:
    """``column >= as_of - INTERVAL amount unit``; ``as_of`` stands for NOW()."""
    return F.col(column) >= as_of - F.expr(f"INTERVAL {int(amount)} {unit}")


def stamp(df: DataFrame, run_ts: Column) -> DataFrame:
    """Append processing time and date; pass the run time so that a rerun writes the same."""
    return df.withColumn("processed_timestamp", run_ts).withColumn(
        "processed_date", run_ts.cast("date")
    )


def select_where(df: DataFrame, fields: list[str], predicate: Column) -> DataFrame:
    return df.where(predicate).select(*fields)


def map_records(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn`` (pandas batch in, pandas batch out) to all rows in Arrow batches."""

    def run(batches: Iterator):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
