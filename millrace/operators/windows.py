"""Window operators that also hold when one group has a large share of all rows.

A native window puts each group into one task. The operators below count rows per key
first. Groups under ``hot_rows`` use the native window; the few above it are cut into
ordered slices (a range partitioning on key and order), worked on slice by slice, and
joined to one carry row per (key, slice). The slices are written to the shared folder, so
both uses see the same cut. Orders must be total where the result depends on row order.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.operators.hotkeys import spread_join
from millrace.session import materialize, plan_bytes, shuffle_partitions

HOT_ROWS = 5_000_000
SLICE_BYTES = 256 * 1024 * 1024

Order = list[tuple[str, bool]]  # (column, ascending)


def ordering(order: Order) -> list[Column]:
    """Sort columns, nulls last in both directions."""
    return [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in order]


def null_safe(left: DataFrame, right: DataFrame, columns: list[str], prefix: str = "") -> Column:
    return reduce(
        lambda a, b: a & b, [left[c].eqNullSafe(right[f"{prefix}{c}"]) for c in columns]
    )


def _renamed(df: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    return df.select(
        *[F.col(c).alias(f"{prefix}{c}") if c in columns else F.col(c) for c in df.columns]
    )


def split_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS):
    """(cold rows, hot rows or None, number of hot rows)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count")).where(F.col("__count") >= hot_rows)
    hot = materialize(counts, "hot-keys")
    rows = hot.agg(F.sum("__count")).first()[0]
    if not rows:
        return df, None, 0
    # at most rows / hot_rows keys; Spark broadcasts them where their files are small, else shuffles
    marks = _renamed(hot.drop("__count"), keys, "__h_")
    match = null_safe(df, marks, keys, "__h_")
    return df.join(marks, match, "left_anti"), df.join(marks, match, "left_semi"), rows


def _sliced(df: DataFrame, keys: list[str], order: Order, rows: int, slice_rows: int) -> DataFrame:
    """Rows with ``__slice``: slices follow the order inside each key; written once."""
    slices = max(2, math.ceil(rows / max(1, slice_rows)))
    ranged = df.repartitionByRange(slices, *[F.col(k) for k in keys], *ordering(order))
    return materialize(ranged.withColumn("__slice", F.spark_partition_id()), "slices")


def _with_carry(sliced: DataFrame, keys: list[str], carry: dict[str, Column]) -> DataFrame:
    """Join each (key, slice) to the totals of the earlier slices of its key.

    The carry table has at most one row per slice plus one per hot key.
    """
    per_slice = sliced.groupBy(*keys, "__slice").agg(
        *[expr.alias(f"__t_{name}") for name, expr in carry.items()]
    )
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(k).alias(f"__o_{k}") for k in keys],
        F.col("__slice").alias("__o_slice"),
        *[
            F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(name)
            for name in carry
        ],
    )
    match = null_safe(sliced, offsets, keys, "__o_") & (sliced["__slice"] == offsets["__o_slice"])
    joined = sliced.join(F.broadcast(offsets), match, "left")
    return joined.drop(*[f"__o_{k}" for k in keys], "__o_slice")


def row_numbers(
    df: DataFrame,
    keys: list[str],
    order: Order,
    out: str = "rn",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """ROW_NUMBER per key in a total order."""
    cold, hot, rows = split_hot(df, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*ordering(order))
    native = cold.withColumn(out, F.row_number().over(window).cast("bigint"))
    if hot is None:
        return native
    return native.unionByName(_number_hot(hot, keys, order, out, rows, hot_rows))


def _number_hot(hot, keys, order, out, rows, slice_rows) -> DataFrame:
    sliced = _sliced(hot, keys, order, rows, slice_rows)
    carried = _with_carry(sliced, keys, {"__before": F.count(F.lit(1))})
    local = Window.partitionBy(*keys, "__slice").orderBy(*ordering(order))
    numbered = carried.withColumn(out, F.row_number().over(local) + F.col("__before"))
    return numbered.drop("__slice", "__before")


def ranks(
    df: DataFrame,
    keys: list[str],
    order: Order,
    rank: str | None = None,
    dense: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """RANK and/or DENSE_RANK per key.

    Hot groups are first counted per distinct order value, so heavy ties shrink before
    anything is ordered; the ranks of the values are then joined back.
    """
    cold, hot, rows = split_hot(df, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*ordering(order))
    native = cold
    if rank:
        native = native.withColumn(rank, F.rank().over(window).cast("bigint"))
    if dense:
        native = native.withColumn(dense, F.dense_rank().over(window).cast("bigint"))
    if hot is None:
        return native

    by = [c for c, _ in order]
    values = hot.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("__n"))
    sliced = _sliced(values, keys, order, rows, hot_rows)
    carried = _with_carry(
        sliced, keys, {"__rows_before": F.sum("__n"), "__values_before": F.count(F.lit(1))}
    )
    local = Window.partitionBy(*keys, "__slice").orderBy(*ordering(order))
    so_far = F.sum("__n").over(local.rowsBetween(Window.unboundedPreceding, 0))
    ranked = carried.select(
        *[F.col(c).alias(f"__v_{c}") for c in keys + by],
        (so_far - F.col("__n") + F.col("__rows_before") + 1).cast("bigint").alias("__rank"),
        (F.row_number().over(local) + F.col("__values_before")).cast("bigint").alias("__dense"),
    )
    back = hot.join(ranked, null_safe(hot, ranked, keys + by, "__v_"), "inner")
    picks = [F.col("__rank").alias(rank)] if rank else []
    picks += [F.col("__dense").alias(dense)] if dense else []
    return native.unionByName(back.select(*[hot[c] for c in df.columns], *picks))


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: Order,
    column: str,
    out: str,
    offset: int = 1,
    default=None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """LEAD (offset > 0) or LAG (offset < 0) of ``column`` per key in a total order."""
    cold, hot, rows = split_hot(df, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(*ordering(order))
    shifted = F.lead(column, offset, default) if offset > 0 else F.lag(column, -offset, default)
    native = cold.withColumn(out, shifted.over(window))
    if hot is None:
        return native
    numbered = materialize(_number_hot(hot, keys, order, "__rn", rows, hot_rows), "numbered")
    others = numbered.select(
        *[F.col(k).alias(f"__n_{k}") for k in keys],
        (F.col("__rn") - offset).alias("__at"),
        F.col(column).alias("__value"),
    )
    match = null_safe(numbered, others, keys, "__n_") & (numbered["__rn"] == others["__at"])
    joined = numbered.join(others, match, "left")
    value = F.when(F.col("__at").isNull(), F.lit(default)).otherwise(F.col("__value"))
    return native.unionByName(
        joined.select(*df.columns, value.cast(df.schema[column].dataType).alias(out))
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: Order,
    column: str,
    out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """SUM(column) from the start of the group to the current row, in a total order."""
    cold, hot, rows = split_hot(df, keys, hot_rows)
    frame = (Window.unboundedPreceding, Window.currentRow)
    window = Window.partitionBy(*keys).orderBy(*ordering(order)).rowsBetween(*frame)
    native = cold.withColumn(out, F.sum(column).over(window))
    if hot is None:
        return native
    sliced = _sliced(hot, keys, order, rows, hot_rows)
    carried = _with_carry(
        sliced, keys, {"__before": F.sum(column), "__values": F.count(F.col(column))}
    )
    local = Window.partitionBy(*keys, "__slice").orderBy(*ordering(order)).rowsBetween(*frame)
    inside = F.sum(column).over(local)
    total = F.when(
        inside.isNull() & (F.col("__values") == 0), F.lit(None)
    ).otherwise(F.coalesce(inside, F.lit(0)) + F.col("__before"))
    summed = carried.withColumn(out, total.cast(native.schema[out].dataType))
    return native.unionByName(summed.drop("__slice", "__before", "__values"))


def range_sum(
    df: DataFrame,
    keys: list[str],
    axis: str,
    width: int,
    column: str,
    out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """SUM(column) over rows of the key with ``axis`` in [current - width, current].

    ``axis`` is an integer column without nulls (for a time, microseconds); ``column`` an
    exact number. In hot groups the sum is a difference of two running sums: up to the
    current value, and up to the last value before the frame. Both come from one sliced
    running sum over the distinct values and the frame starts.
    """
    cold, hot, rows = split_hot(df, keys, hot_rows)
    window = Window.partitionBy(*keys).orderBy(axis).rangeBetween(-width, 0)
    native = cold.withColumn(out, F.sum(column).over(window))
    if hot is None:
        return native
    values = hot.groupBy(*keys, axis).agg(
        F.sum(column).alias("__sum"), F.count(column).alias("__n")
    ).withColumn("__sum", F.coalesce("__sum", F.lit(0)))
    ends = values.select(*keys, F.col(axis).alias("__for"), F.lit(1).alias("__sign"), F.col(axis).alias("__at"), "__sum", "__n")
    # a frame starts after all rows up to this point
    starts = ends.select(*keys, "__for", F.lit(-1).alias("__sign"), (F.col("__at") - width - 1).alias("__at"),
                         (F.col("__sum") * 0).cast(values.schema["__sum"].dataType).alias("__sum"), F.lit(0).cast("bigint").alias("__n"))
    # at the same point the rows come before the frame starts
    order = [("__at", True), ("__sign", False), ("__for", True)]
    sliced = _sliced(ends.unionByName(starts), keys, order, 2 * rows, hot_rows)
    carried = _with_carry(sliced, keys, {"__sum_before": F.sum("__sum"), "__n_before": F.sum("__n")})
    local = (
        Window.partitionBy(*keys, "__slice").orderBy(*ordering(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = carried.select(
        *keys,
        "__for",
        ((F.sum("__sum").over(local) + F.col("__sum_before")) * F.col("__sign")).alias("__sum"),
        ((F.sum("__n").over(local) + F.col("__n_before")) * F.col("__sign")).alias("__n"),
    )
    # two rows each: the frame's end and its start
    frames = running.groupBy(*keys, "__for").agg(F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))
    frames = _renamed(frames.withColumnRenamed("__for", axis), [*keys, axis], "__f_")
    total = F.when(F.col("__n") > 0, F.col("__sum")).cast(native.schema[out].dataType)
    back = hot.join(frames, null_safe(hot, frames, [*keys, axis], "__f_"), "inner")
    return native.unionByName(back.select(*df.columns, total.alias(out)))


def group_totals(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of the whole group beside each row.

    An aggregate with map-side combine and a join back, instead of a window: no group is
    gathered in one task, the joined side has one row per key, and the rows of hot keys are
    dealt over many tasks.
    """
    totals = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    totals = _renamed(totals, keys, "__g_")
    joined = spread_join(df, totals, [(k, f"__g_{k}") for k in keys], right_unique=True, null_safe=True)
    return joined.drop(*[f"__g_{k}" for k in keys])


def top_per_group(df: DataFrame, keys: list[str], order: Order, n: int, out: str = "rn") -> DataFrame:
    """The first ``n`` rows of each key.

    Spark limits each group before the shuffle (WindowGroupLimit), so a hot group sends
    at most ``n`` rows per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*ordering(order))
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)


def latest_per_key(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_per_group(df, keys, order, 1, "__rn").drop("__rn")


def global_row_numbers(
    df: DataFrame, order: Order, out: str = "rn", slices: int | None = None
) -> DataFrame:
    """1, 2, 3 … over the whole table in a total order, without a one-partition window."""
    if slices is None:
        slices = max(shuffle_partitions(df.sparkSession), math.ceil(plan_bytes(df) / SLICE_BYTES))
    ranged = df.repartitionByRange(slices, *ordering(order)).sortWithinPartitions(*ordering(order))
    ids = F.monotonically_increasing_id()
    # the id carries the partition above bit 33 and the position in it below
    placed = ranged.withColumn("__slice", F.shiftright(ids, 33)).withColumn(
        "__pos", ids.bitwiseAND(F.lit((1 << 33) - 1))
    )
    placed = materialize(placed, "numbered")
    per_slice = placed.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(  # one row per slice
        F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    joined = placed.join(F.broadcast(offsets), F.col("__slice") == F.col("__s"))
    numbered = joined.withColumn(out, F.col("__pos") + F.col("__before") + 1)
    return numbered.drop("__slice", "__s", "__pos", "__before")
