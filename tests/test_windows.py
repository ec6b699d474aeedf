"""The sliced way of hot groups must give what the native window gives."""

import pytest
from pyspark.sql import Window, functions as F

from millrace.operators import windows as wn
from tests.conftest import plan_text, rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values and order columns repeat and have nulls."""
    i = F.col("id")
    return spark.range(4000).select(
        F.when(i % 5 < 3, F.lit("hot")).when(i % 50 == 3, F.lit(None)).otherwise(F.concat(F.lit("k"), i % 7)).alias("k"),
        i,
        F.when(i % 11 == 0, F.lit(None)).otherwise(i * 7919 % 97).alias("o"),
        F.when(i % 13 == 0, F.lit(None)).otherwise(i * 31 % 101).cast("decimal(18,2)").alias("v"),
    )


TOTAL = [("o", True), ("id", False)]


def native_window():
    return Window.partitionBy("k").orderBy(F.asc_nulls_last("o"), F.desc_nulls_last("id"))


def test_split_hot_is_a_partition(skewed):
    cold, hot, n = wn.split_hot(skewed, ["k"], 500)
    assert hot.select("k").distinct().count() == 1 and hot.count() == n == 2400
    assert cold.count() + n == 4000


def test_row_numbers(skewed):
    got = wn.row_numbers(skewed, ["k"], TOTAL, hot_rows=300)
    want = skewed.withColumn("rn", F.row_number().over(native_window()))
    assert rows(got, "id", "rn") == rows(want, "id", "rn")


@pytest.mark.parametrize("up", [True, False])
def test_ranks(skewed, up):
    got = wn.ranks(skewed, ["k"], [("o", up)], rank="r", dense="d", hot_rows=300)
    w = Window.partitionBy("k").orderBy(F.asc_nulls_last("o") if up else F.desc_nulls_last("o"))
    want = skewed.withColumn("r", F.rank().over(w)).withColumn("d", F.dense_rank().over(w))
    assert rows(got, "id", "r", "d") == rows(want, "id", "r", "d")


@pytest.mark.parametrize("offset,default", [(1, None), (-1, None), (3, -5), (-2, 0)])
def test_neighbour(skewed, offset, default):
    df = skewed.withColumn("x", F.col("id") * 2)
    got = wn.neighbour(df, ["k"], TOTAL, "x", "n", offset, default, hot_rows=300)
    shifted = F.lead("x", offset, default) if offset > 0 else F.lag("x", -offset, default)
    want = df.withColumn("n", shifted.over(native_window()))
    text = F.coalesce(F.col("n").cast("string"), F.lit("-"))
    assert rows(got.withColumn("n", text), "id", "n") == rows(want.withColumn("n", text), "id", "n")


def test_running_sum(skewed):
    got = wn.running_sum(skewed, ["k"], TOTAL, "v", "s", hot_rows=300)
    frame = native_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = skewed.withColumn("s", F.sum("v").over(frame))
    text = F.coalesce(F.col("s").cast("string"), F.lit("-"))
    assert rows(got.withColumn("s", text), "id", "s") == rows(want.withColumn("s", text), "id", "s")


def test_range_sum(skewed):
    df = skewed.where("o IS NOT NULL")
    got = wn.range_sum(df, ["k"], "o", 9, "v", "s", hot_rows=300)
    want = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("o").rangeBetween(-9, 0)))
    text = F.coalesce(F.col("s").cast("string"), F.lit("-"))
    assert rows(got.withColumn("s", text), "id", "s") == rows(want.withColumn("s", text), "id", "s")


def test_group_totals(skewed):
    got = wn.group_totals(skewed, ["k"], {"n": F.count(F.lit(1)), "m": F.max("id")})
    w = Window.partitionBy("k")
    want = skewed.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("m", F.max("id").over(w))
    assert rows(got, "id", "n", "m") == rows(want, "id", "n", "m")


def test_global_row_numbers(skewed):
    got = wn.global_row_numbers(skewed, TOTAL, slices=7)
    w = Window.orderBy(F.asc_nulls_last("o"), F.desc_nulls_last("id"))
    want = skewed.withColumn("rn", F.row_number().over(w))
    assert rows(got, "id", "rn") == rows(want, "id", "rn")


def test_top_per_group_limits_before_the_shuffle(skewed):
    top = wn.top_per_group(skewed, ["k"], TOTAL, 3)
    text = plan_text(top)
    assert text.index("WindowGroupLimit") and text.count("WindowGroupLimit") >= 2
    assert top.where("k = 'hot'").count() == 3
