"""Equi-joins whose keys may be held by a large share of the rows, spread before the join.

A frequent-items sketch of each side finds the hot keys: those with more rows than a task should have. The
rows of a hot key are dealt over a grid of cells: a row of the left side belongs to one line of the grid and
is copied to its columns, a row of the right side to one column and is copied to its lines, so each pair
meets in exactly one cell. A key that is hot on one side only has a grid of one line or one column: the hot
side is not copied at all. All other keys have one cell, and everything is one equi-join on key and cell.

The sketches are part of the plan: no job runs while it is built. Their tables have ``MOST`` rows at most
and are broadcast; what the sketch misses or guesses wrong costs balance, never a row.

This does not depend on what adaptive execution can split: it holds for any side of an outer join, and where
the other side is an aggregate on the join key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from millrace.session import shuffle_partitions

MOST = 1000  # keys told apart as hot, per side
TRACKED = 20_000  # counters of the sketch: a key of more than 1 / 15,000 of the rows is not missed
LEAST_ROWS = 10_000  # a task may have so many rows of one key, however few partitions there are
FINE = 4  # cells per task's share, so that hashing cells to tasks evens out
MOST_CELLS = 4096


def _hash(columns: list[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])


def _row_hash(df: DataFrame) -> Column:
    """A number that depends on the row's values only, so that a repeated task deals rows alike."""
    plain = [f"`{f.name.replace('`', '``')}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, MapType)]
    return F.xxhash64(F.lit(1), *[F.col(c) for c in plain])


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def hot_keys(df: DataFrame, keys: list[str], out: str, least_rows: int | None = None, null_safe: bool = False) -> DataFrame:
    """(__hot, out): hashes of the hot keys and the cells each is dealt over; at most ``MOST`` rows."""
    parts = shuffle_partitions(df.sparkSession)
    hashed = (df if null_safe else df.where(_known(keys))).select(_hash(keys).alias("h"))
    sketch = hashed.agg(F.expr(f"approx_top_k(h, {MOST}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("total"))
    found = sketch.select(F.explode("top").alias("t"), "total").select(F.col("t.item").alias("__hot"), F.col("t.count").alias("n"), "total")
    share = F.greatest(F.lit(least_rows or LEAST_ROWS), F.ceil(F.col("total") / parts))
    cells = F.least(F.lit(MOST_CELLS), F.ceil(FINE * F.col("n") / share)).cast("int")
    return found.where(F.col("n") > share).select("__hot", cells.alias(out))


def spread(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    right_unique: bool = False,
    null_safe: bool = False,
    least_rows: int | None = None,
    seen: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``__cell`` (left) and ``__cell_r`` (right) to be joined beside the keys.

    A right side of one row per key (``right_unique``) is not looked at for hot keys. Rows of the left side
    with a null key, which meet nothing unless the join is ``null_safe``, are dealt over cells of their own.
    ``seen`` has the left side's keys as often as the left side, where that is cheaper to read twice.
    """
    lefts, rights = [l for l, _ in on], [r for _, r in on]
    hot = hot_keys(left if seen is None else seen, lefts, "__lines", least_rows, null_safe).withColumn("__columns", F.lit(1))
    if not right_unique:
        other = hot_keys(right, rights, "__columns", least_rows, null_safe)
        hot = hot.unionByName(other.select("__hot", F.lit(1).alias("__lines"), "__columns"))
        hot = hot.groupBy("__hot").agg(F.max("__lines").alias("__lines"), F.max("__columns").alias("__columns"))
    hot = F.broadcast(hot)  # 2 * MOST rows of three numbers

    def dealt(df: DataFrame, keys: list[str], out: str, own: str, copied: str) -> DataFrame:
        marked = df.join(hot, _hash(keys) == F.col("__hot"), "left")
        mine = F.pmod(_row_hash(df), F.coalesce(own, F.lit(1))).cast("int")
        others = F.sequence(F.lit(0), F.coalesce(copied, F.lit(1)) - 1)
        columns = F.coalesce("__columns", F.lit(1))
        cell = (lambda o: mine * columns + o) if own == "__lines" else (lambda o: o * columns + mine)
        cells = F.transform(others, cell)
        if own == "__lines" and not null_safe:
            lone = -1 - F.pmod(_row_hash(df), F.lit(MOST_CELLS)).cast("int")
            cells = F.when(_known(keys), cells).otherwise(F.array(lone))
        return marked.withColumn(out, F.explode(cells)).drop("__hot", "__lines", "__columns")

    return dealt(left, lefts, "__cell", "__lines", "__columns"), dealt(right, rights, "__cell_r", "__columns", "__lines")


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[tuple[str, str]],
    how: str = "inner",
    right_unique: bool = False,
    null_safe: bool = False,
    least_rows: int | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Inner, left_semi or left_anti equi-join, spread; column names of the sides must not overlap.

    Semi and anti joins need a right side of one row per key: then no left row is copied, and none can be
    kept in one cell and dropped in another. ``null_safe`` lets null keys meet; ``seen`` as in ``spread``.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"unknown kind of join: {how}")
    if how != "inner" and not right_unique:
        raise ValueError(f"{how} needs a right side of one row per key")
    a, b = spread(left, right, on, right_unique, null_safe, least_rows, seen)
    same = [(a[l].eqNullSafe(b[r]) if null_safe else a[l] == b[r]) for l, r in on]
    joined = a.join(b, reduce(lambda x, y: x & y, [*same, a["__cell"] == b["__cell_r"]]), how)
    return joined.drop("__cell", "__cell_r")
