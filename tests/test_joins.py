import pytest
from pyspark.sql import functions as F

from millrace.operators import joins as jn
from tests.conftest import executed_plan, plan_text, rows


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (5, "e")], "lk int, lv string")
    right = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "n"), (5, "w")], "rk int, rv string")
    return left, right


def _text(df):
    return rows(df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("lk", "lv", "rk", "rv")]))


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_join_equals_native(sides, how):
    left, right = sides
    got = jn.outer_join(left, right, [("lk", "rk")], how)
    assert _text(got) == _text(left.join(right, left.lk == right.rk, how))


def test_outer_join_rejects_other_kinds(sides):
    with pytest.raises(ValueError):
        jn.outer_join(*sides, [("lk", "rk")], "inner")


def test_unmatched(sides):
    left, right = sides
    assert {r.lv for r in jn.unmatched(left, right, [("lk", "rk")]).collect()} == {"a", "d"}


@pytest.mark.parametrize(
    "left_mb,right_mb,how,want",
    [
        (100, 2000, "inner", ("broadcast", "left")),
        (2000, 50, "inner", ("broadcast", "right")),
        (300, 5000, "inner", ("merge", None)),
        (300, 400, "inner", ("shuffle_hash", None)),
        (100, 2000, "left", ("merge", None)),  # the kept side is never built
        (100, 150, "left", ("broadcast", "right")),
        (2000, 50, "right", ("merge", None)),
        (100, 100, "full", ("shuffle_hash", None)),
        (10, 2000, "left_anti", ("merge", None)),
    ],
)
def test_choose_strategy(left_mb, right_mb, how, want):
    assert jn.choose_strategy(left_mb, right_mb, how) == want


def test_size_aware_join_follows_given_sizes(tables):
    lines, orders = tables.lineitem, tables.orders
    on = [("l_orderkey", "o_orderkey")]
    assert "SortMergeJoin" in plan_text(jn.size_aware_join(lines, orders, on, left_mb=5000, right_mb=400))
    assert "ShuffledHashJoin" in plan_text(jn.size_aware_join(lines, orders, on, left_mb=500, right_mb=400))
    assert "BroadcastHashJoin" in plan_text(jn.size_aware_join(lines, orders, on))


def test_broadcast_needs_a_measured_size(tables, monkeypatch):
    on = [("l_orderkey", "o_orderkey")]
    assert jn.fits_broadcast(tables.orders)
    assert not jn.fits_broadcast(tables.orders, limit_mb=0.001)
    monkeypatch.setattr(jn, "fits_broadcast", lambda df: False)
    assert "SortMergeJoin" in plan_text(jn.checked_broadcast_join(tables.lineitem, tables.orders, on))


def test_pair_with_all(spark):
    left, right = spark.range(50).toDF("a"), spark.range(4).toDF("b")
    both = jn.pair_with_all(left, right, 3)
    assert rows(both) == rows(left.crossJoin(right))
    plan = executed_plan(both)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hot_key_of_an_outer_join_is_spread_without_adaptive_splits(spark):
    """Two thirds of the rows hold one key; no task gets a large share of what is joined."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(keep, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        i = F.col("id")
        many = spark.range(0, 60000, 1, 8).select(F.when(i % 3 > 0, 7).otherwise(i % 1000).alias("rk"), F.md5(i.cast("string")).alias("rv"))
        few = spark.range(2000).select(i.alias("lk"))
        joined = jn.outer_join(few, many, [("lk", "rk")], "left")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.45 * sum(sizes)
        native = few.join(many, few.lk == many.rk, "left")
        assert sum(sizes) == native.count()
        assert max(r["count"] for r in native.groupBy(F.spark_partition_id()).count().collect()) > 0.6 * sum(sizes)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
