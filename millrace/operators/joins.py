"""Join helpers that stay balanced when one key holds a large share of the rows.

Inner joins are split by adaptive execution where both sides come straight from a shuffle. It cannot split
the kept side of an outer join, nor a join whose other side is aggregated on the join key in the same stage.
The outer joins here are an inner join plus the unmatched rows found by an anti join on distinct keys, and
both deal the rows of hot keys over many tasks by themselves (``hotkeys``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.hotkeys import spread_join
from millrace.session import plan_bytes, shuffle_partitions

MB = 1024 * 1024

# Fixed size limits of the join choice, in MB.
BROADCAST_LIMIT_MB = 200
LARGE_TABLE_MB = 1000


def key_condition(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[l] == right[r] for l, r in on])


def _padded(df: DataFrame, schema_of: DataFrame) -> DataFrame:
    """Add the columns of ``schema_of`` as typed nulls."""
    return df.select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema_of.schema.fields]
    )


def unmatched(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` without a partner in ``right``, those with a null key among them."""
    keys = right.select(*[F.col(r).alias(f"__k{i}") for i, (_, r) in enumerate(on)])
    keys = keys.dropna("any").distinct()
    pairs = [(l, f"__k{i}") for i, (l, _) in enumerate(on)]
    return spread_join(left, keys, pairs, "left_anti", right_unique=True)


def not_in(left: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows of ``left`` for which ``column NOT IN (SELECT value FROM values)`` is true, by SQL's rule for nulls.

    No values: every row, also a null one. A null among the values: no row, since no comparison with it is
    false. Otherwise the rows with a known value that is not among them. The two flags are scalar subqueries,
    the rest is an anti join; no row is compared with all values.
    """
    found = values.select(F.col(value).alias("__value"))
    none = found.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    unknown = found.agg((F.count(F.when(F.col("__value").isNull(), 1)) > 0).alias("unknown")).scalar()
    lone = unmatched(left, found, [(column, "__value")])
    return lone.where(none | (~unknown & F.col(column).isNotNull()))


def outer_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str) -> DataFrame:
    """Left, right or full outer join whose two sides may both be skewed.

    ``on`` lists (left column, right column) pairs; column names must not overlap.
    """
    if how not in ("left", "right", "full"):
        raise ValueError(f"unknown outer join kind: {how}")
    columns = left.columns + right.columns
    parts = [spread_join(left, right, on).select(*columns)]
    if how in ("left", "full"):
        parts.append(_padded(unmatched(left, right, on), right).select(*columns))
    if how in ("right", "full"):
        swapped = [(r, l) for l, r in on]
        parts.append(_padded(unmatched(right, left, swapped), left).select(*columns))
    return reduce(DataFrame.unionAll, parts)


def decoded_mb(df: DataFrame) -> float:
    """Measured size of a frame once decoded: eight bytes per fixed value, text by length."""
    width = F.lit(0)
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + 16
        else:
            width = width + 8
    total = df.agg(F.sum(width.cast("bigint"))).first()[0]
    return (total or 0) / MB


def plan_mb(df: DataFrame) -> float:
    return plan_bytes(df) / MB


def fits_broadcast(df: DataFrame, limit_mb: float = BROADCAST_LIMIT_MB) -> bool:
    """True only if a measured size proves the frame is small enough to broadcast.

    File bytes are looked at first, so a large table is turned down without a scan.
    """
    return plan_mb(df) <= limit_mb and decoded_mb(df) <= limit_mb


def choose_strategy(
    left_mb: float,
    right_mb: float,
    how: str = "inner",
    broadcast_limit_mb: float = BROADCAST_LIMIT_MB,
    large_mb: float = LARGE_TABLE_MB,
) -> tuple[str, str | None]:
    """(strategy, side to build) from two sizes; an outer join never builds its kept side."""
    side = "left" if left_mb < right_mb else "right"
    if min(left_mb, right_mb) <= broadcast_limit_mb:
        kept = {"left": "left", "left_semi": "left", "left_anti": "left", "right": "right"}.get(how)
        if how != "full" and side != kept:
            return "broadcast", side
        other = "right" if side == "left" else "left"
        if how != "full" and (right_mb if other == "right" else left_mb) <= broadcast_limit_mb:
            return "broadcast", other
    if max(left_mb, right_mb) > large_mb:
        return "merge", None
    return "shuffle_hash", None


def size_aware_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    how: str = "inner",
    left_mb: float | None = None,
    right_mb: float | None = None,
    broadcast_limit_mb: float = BROADCAST_LIMIT_MB,
) -> DataFrame:
    """Join by the strategy the measured sizes call for."""

    def size(df: DataFrame) -> float:
        on_disk = plan_mb(df)
        return on_disk if on_disk > broadcast_limit_mb else decoded_mb(df)

    left_mb = size(left) if left_mb is None else left_mb
    right_mb = size(right) if right_mb is None else right_mb
    strategy, side = choose_strategy(left_mb, right_mb, how, broadcast_limit_mb)
    cond = key_condition(left, right, on)
    if strategy == "broadcast" and side == "left":
        return F.broadcast(left).join(right, cond, how)
    if strategy == "broadcast":
        return left.join(F.broadcast(right), cond, how)
    return left.join(right.hint(strategy), cond, how)


def checked_broadcast_join(
    left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner"
) -> DataFrame:
    """Broadcast the right side if its measured size allows; a sort-merge join otherwise."""
    small = F.broadcast(right) if fits_broadcast(right) else right.hint("merge")
    return left.join(small, key_condition(left, right, on), how)


def pair_with_all(left: DataFrame, right: DataFrame, stripes: int | None = None) -> DataFrame:
    """Every row of ``left`` beside every row of ``right``: a join without a condition.

    The result is laid out as stripes: each right row is copied to every stripe and each
    left row belongs to exactly one, so the work is an equi-join on the stripe number and
    no task holds the whole product.
    """
    if stripes is None:
        stripes = shuffle_partitions(left.sparkSession)
    lhs = left.withColumn("__stripe", F.pmod(F.xxhash64(*left.columns), F.lit(stripes)).cast("int"))
    rhs = right.withColumn("__stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    return lhs.join(rhs, "__stripe").drop("__stripe")
