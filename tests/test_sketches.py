import pytest
from pyspark.sql import functions as F

from millrace.operators import sketches as sk


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "table"), str(tmp_path / "store")


def stats(spark, place):
    return {r.column_name: r for r in sk.merged(spark, *place).collect()}


def test_an_append_reads_only_its_file_and_estimates_hold(spark, place):
    i = F.col("id")
    rows = spark.range(60_000).select(
        (i * 7919 % 50_000).alias("n"), F.when(i % 4 > 0, i / 3).alias("x"), F.concat(F.lit("k"), i % 900).alias("a.b"), F.array(i).alias("list")
    )
    rows.where("n % 5 > 0").coalesce(2).write.parquet(place[0])
    assert sk.refresh(spark, *place) == 2 and sk.refresh(spark, *place) == 0
    known = {r.file for r in spark.read.parquet(place[1]).collect()}
    rows.where("n % 5 = 0").coalesce(1).write.mode("append").parquet(place[0])
    assert sk.refresh(spark, *place) == 1
    stored = spark.read.parquet(place[1])
    assert stored.count() == 3 and stored.where(~F.col("file").isin(*known)).first().n_rows == rows.where("n % 5 = 0").count()

    got = stats(spark, place)
    exact = rows.agg(
        F.countDistinct("n").alias("n"), F.countDistinct("x").alias("x"), F.countDistinct("`a.b`").alias("a.b"), F.count("x").alias("c")
    ).first()
    for name in ("n", "x", "a.b"):
        assert abs(got[name].n_distinct / exact[name] - 1) < 4 * 1.04 / 2 ** (sk.LG_BINS / 2)
    assert (got["x"].n_rows, got["x"].n_nulls, got["a.b"].low, got["a.b"].high) == (60_000, 60_000 - exact.c, "k0", "k99")
    assert (got["n"].low, got["n"].high, got["list"].n_nulls, got["list"].n_distinct) == ("0", "49999", 0, None)
    for name in ("n", "x"):
        for q, value in zip(sk.QUARTILES, got[name].quartiles):
            below = rows.where(F.col(name).isNotNull()).agg(F.avg((F.col(name) <= value).cast("int"))).first()[0]
            assert abs(below - q) < 3 * 0.0133


def test_files_written_anew_or_removed(spark, place):
    part = F.concat(F.lit("a "), F.col("id") % 2)
    spark.range(10).withColumn("day", part).coalesce(1).write.partitionBy("day").parquet(place[0])
    assert sk.refresh(spark, *place) == sk.refresh(spark, *place) + 2
    assert stats(spark, place)["day"].high == "a 1" and stats(spark, place)["id"].n_rows == 10
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        spark.range(100, 107).withColumn("day", F.lit("a 1")).coalesce(1).write.mode("overwrite").partitionBy("day").parquet(place[0])
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert sk.refresh(spark, *place) == 1
    row = stats(spark, place)["id"]
    assert (row.n_rows, row.low, row.high) == (12, "0", "106")


def test_nulls_nan_and_empty_tables(spark, place):
    data = [(None, None, None), (float("nan"), "", None), (1.5, "z", None)]
    spark.createDataFrame(data, "file double, columns string, void int").coalesce(1).write.parquet(place[0])
    sk.refresh(spark, *place)
    got = stats(spark, place)
    assert (got["file"].n_nulls, got["file"].low, got["file"].high, got["file"].quartiles) == (1, "1.5", "NaN", [1.5, 1.5, 1.5])
    assert (got["columns"].low, got["columns"].n_distinct) == ("", 2)
    assert (got["void"].n_nulls, got["void"].low, got["void"].n_distinct, got["void"].quartiles) == (3, None, 0, None)


def test_empty_table(spark, place):
    spark.createDataFrame([], "a int, b string").write.parquet(place[0])
    sk.refresh(spark, *place)
    assert [(r.n_rows, r.n_nulls, r.low, r.n_distinct) for r in stats(spark, place).values()] == [(0, 0, None, 0)] * 2
