"""Aggregates that need more than one built-in call, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.windows import Order, ordering


def distinct_count(
    df: DataFrame, keys: list[str], column: str, out: str, approximate: bool = False
) -> DataFrame:
    """COUNT(DISTINCT column) per key; Spark shuffles by (key, value), so a hot key spreads."""
    count = F.approx_count_distinct(column) if approximate else F.countDistinct(column)
    return df.groupBy(*keys).agg(count.alias(out))


def string_agg(
    df: DataFrame,
    keys: list[str],
    column: str,
    out: str,
    separator: str = ",",
    distinct: bool = True,
) -> DataFrame:
    """STRING_AGG(column, separator ORDER BY column).

    With ``distinct`` repeated values are removed by a shuffle on (key, value) first, so
    the text of a group grows with its values and not with its rows.
    """
    if distinct:
        df = df.select(*keys, column).distinct()
    text = separator.replace("'", "''")
    return df.groupBy(*keys).agg(
        F.expr(f"listagg({column}, '{text}') WITHIN GROUP (ORDER BY {column})").alias(out)
    )


def array_agg(
    df: DataFrame, keys: list[str], column: str, out: str, distinct: bool = True
) -> DataFrame:
    """ARRAY_AGG(column), sorted so that the result does not depend on partitioning."""
    if distinct:
        df = df.select(*keys, column).distinct()
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias(out))


def safe_ratio(numerator: str, denominator: str, digits: int | None = None) -> Column:
    """``a / NULLIF(b, 0)``, rounded if asked."""
    ratio = F.try_divide(numerator, denominator)
    return ratio if digits is None else F.round(ratio, digits)


def top_k(df: DataFrame, order: Order, k: int) -> DataFrame:
    """ORDER BY … LIMIT k; each partition keeps k rows before anything moves."""
    return df.orderBy(*ordering(order)).limit(k)
