"""Joins of hot keys: equal to Spark's own joins, and spread whatever stands on the other side."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from millrace.operators import cdc, etl, hotkeys, joins as jn, windows as wn
from tests.conftest import rows

@contextmanager
def settings(spark, **values):
    keep = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows hold key 7, a sixth hold no key."""
    i = F.col("id")
    key = F.when(i % 3 == 0, 7).when(i % 6 == 1, None).otherwise(i % 1000).cast("int")
    return spark.range(0, 30_000, 1, 8).select(key.alias("lk"), i.alias("lv"))


@pytest.fixture(scope="module")
def other(spark):
    i = F.col("id")
    key = F.when(i % 20 == 0, 7).when(i % 20 == 1, None).otherwise(i % 1500).cast("int")
    return spark.range(0, 400, 1, 4).select(key.alias("rk"), (i * 2).alias("rv"))


def digest(df):
    """Count and a sum of row hashes: equal for equal bags of rows."""
    names = sorted(df.columns)
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*names).cast("decimal(38,0)"))).first())


@pytest.mark.parametrize("least", [50, hotkeys.LEAST_ROWS])
def test_spread_joins_equal_native_ones(hot, other, least):
    on = [("lk", "rk")]
    same = F.col("lk") == F.col("rk")
    assert digest(hotkeys.spread_join(hot, other, on, least_rows=least)) == digest(hot.join(other, same))
    assert digest(hotkeys.spread_join(other, hot, [("rk", "lk")], least_rows=least)) == digest(other.join(hot, same))
    keys = other.select("rk").distinct()
    for how in ("left_semi", "left_anti"):
        got = hotkeys.spread_join(hot, keys, on, how, right_unique=True, least_rows=least)
        assert digest(got) == digest(hot.join(other, same, how))
    totals = hot.groupBy(F.col("lk").alias("rk")).agg(F.sum("lv").alias("rv"))
    got = hotkeys.spread_join(hot, totals, on, right_unique=True, null_safe=True, least_rows=least)
    assert digest(got) == digest(hot.join(totals, F.col("lk").eqNullSafe(F.col("rk"))))


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins_of_hot_keys(hot, other, how, monkeypatch):
    monkeypatch.setattr(hotkeys, "LEAST_ROWS", 100)
    native = hot.join(other, F.col("lk") == F.col("rk"), how)
    assert digest(jn.outer_join(hot, other, [("lk", "rk")], how)) == digest(native)
    both = etl.combine_sources([hot.withColumnRenamed("lk", "k"), other.withColumnRenamed("rk", "k")], ["k"], how=how)
    assert digest(both) == digest(hot.withColumnRenamed("lk", "k").join(other.withColumnRenamed("rk", "k"), "k", how))


def test_kinds_that_need_unique_keys(hot, other):
    with pytest.raises(ValueError):
        hotkeys.spread_join(hot, other, [("lk", "rk")], "left_anti")
    with pytest.raises(ValueError):
        hotkeys.spread_join(hot, other, [("lk", "rk")], "full")


def test_the_sketch_finds_what_holds_a_large_share(hot):
    found = {r["__hot"]: r.cells for r in hotkeys.hot_keys(hot, ["lk"], "cells", least_rows=100).collect()}
    seven = hot.limit(1).select(F.xxhash64(F.lit(7)).alias("h")).first().h
    assert found == {seven: found[seven]} and found[seven] > 1


def largest_share(df):
    """Rows of the fullest partition and of all, of what a join hands on."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


@pytest.mark.parametrize("case", ["inner", "unmatched", "group_totals", "merge", "null keys"])
def test_a_key_with_a_third_of_the_rows_is_spread(spark, hot, other, case, monkeypatch):
    """Each place the joined side of which is an aggregate on the key; no help from adaptive execution."""
    monkeypatch.setattr(hotkeys, "LEAST_ROWS", 100)
    none = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    with settings(spark, **none):
        if case == "inner":
            out, native = hotkeys.spread_join(hot, other, [("lk", "rk")]), hot.join(other, F.col("lk") == F.col("rk"))
        elif case == "unmatched":
            out, native = jn.unmatched(hot, other.where("rk <> 7"), [("lk", "rk")]), hot.join(other.where("rk <> 7"), F.col("lk") == F.col("rk"), "left_anti")
        elif case == "group_totals":
            out, native = wn.group_totals(hot, ["lk"], {"total": F.sum("lv")}), None
        elif case == "null keys":
            nulls = hot.withColumn("lk", F.when(F.col("lv") % 2 == 0, None).otherwise(F.col("lk")))
            out, native = jn.unmatched(nulls, other, [("lk", "rk")]), nulls.join(other, F.col("lk") == F.col("rk"), "left_anti")
        else:
            changes = other.where("rk <> 7").select(F.col("rk").alias("lk"), F.col("rv").alias("lv"))
            out, native = cdc.merge(hot, changes, ["lk"], [("lv", False)]), None
        assert largest_share(out) < 0.25
        if native is not None:
            assert largest_share(native) > 0.3
            assert digest(out) == digest(native)


def test_no_job_runs_while_a_spread_join_is_planned(spark, hot, other):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    jn.outer_join(hot, other, [("lk", "rk")], "full")
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")


VALUES = "v int"


@pytest.mark.parametrize("values", [[], [(None,)], [(1,), (None,)], [(1,), (3,)], [(9,)]])
def test_not_in_follows_the_null_rule(spark, values):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (2, "b")], "k int, n string")
    listed = spark.createDataFrame(values, VALUES)
    left.createOrReplaceTempView("not_in_left")
    listed.createOrReplaceTempView("not_in_values")
    want = spark.sql("SELECT * FROM not_in_left WHERE k NOT IN (SELECT v FROM not_in_values)")
    got = jn.not_in(left, "k", listed, "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rows_are_kept_once(hot):
    assert rows(jn.unmatched(hot, hot.limit(0), [("lk", "lk")]).agg(F.count(F.lit(1)))) == [(30_000,)]
