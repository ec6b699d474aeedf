import pytest
from pyspark.sql import functions as F

from millrace.operators import cdc, incremental as inc
from millrace.session import scratch_path
from millrace.sources.files import ensure_database
from millrace.streaming.bookmarks import run_bookmarked
from tests.conftest import rows


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def events(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- marks and watermarks ----------------------------------------------------------


def test_marks_of_jobs_do_not_touch_each_other(spark):
    marks = inc.MarkStore(spark, scratch_path(spark, "marks"))
    assert marks.get("a") is None and marks.runs("a") == 0
    marks.set("a", "1")
    marks.set("b", "5")
    marks.set("a", "2")
    assert (marks.get("a"), marks.get("b"), marks.runs("a")) == ("2", "5", 2)


def test_watermark_keeps_late_rows_that_tie_with_the_mark(spark):
    path = scratch_path(spark, "wm")
    marks = inc.MarkStore(spark, f"{path}/marks")
    first = events(spark, (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"))
    tie = first.union(events(spark, (3, "2024-01-02 00:00:00")))
    more = tie.union(events(spark, (4, "2024-01-02 00:00:00"), (5, "2024-01-03 00:00:00")))
    counts = [inc.load_watermark(df, path, "ts", "j", marks, ["id"])["rows"] for df in (first, tie, more, more)]
    assert counts == [2, 1, 2, 0]
    assert rows(spark.read.parquet(f"{path}/data"), "id") == [(1,), (2,), (3,), (4,), (5,)]


def test_watermark_run_can_be_repeated_after_a_failure(spark, monkeypatch):
    path = scratch_path(spark, "wm")
    marks = inc.MarkStore(spark, f"{path}/marks")
    df = events(spark, (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"))

    def dies(job, value):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(marks, "set", dies)
        with pytest.raises(OSError):
            inc.load_watermark(df, path, "ts", "j", marks, ["id"])
    assert inc.load_watermark(df, path, "ts", "j", marks, ["id"])["rows"] == 2
    assert rows(spark.read.parquet(f"{path}/data"), "id") == [(1,), (2,)]


def test_watermark_transform(spark):
    path = scratch_path(spark, "wm")
    marks = inc.MarkStore(spark, f"{path}/marks")
    df = events(spark, (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"))
    inc.load_watermark(df, path, "ts", "j", marks, ["id"], "SELECT id * 10 AS x FROM {source_table} WHERE id > 1")
    assert rows(spark.read.parquet(f"{path}/data"), "x") == [(20,)]


def test_run_log(spark):
    path = scratch_path(spark, "wm")
    marks = inc.MarkStore(spark, f"{path}/marks")
    df = events(spark, (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00"), (3, "2024-01-03 00:00:00"))
    for cut in ("2024-01-02", "2024-01-04"):
        inc.load_watermark(df.where(F.col("ts") < at(cut)), path, "ts", "j", marks, ["id"], log=f"{path}/log")
    got = inc.run_report(spark, f"{path}/log", at("2024-01-03 00:01:00")).first()
    assert (got.runs, got.records, got.mark, got.age_seconds) == (2, 3, "2024-01-03 00:00:00", 60)
    assert got.mean_seconds > 0


def test_lookback_rerun_replaces_whole_days(spark):
    path = scratch_path(spark, "lb")
    df = events(spark, (1, "2024-01-01 10:00:00"), (2, "2024-01-02 01:00:00"))
    inc.load_lookback(df, path, "ts", at("2024-01-02 12:00:00"), 24)
    late = df.union(events(spark, (3, "2024-01-01 09:00:00")))
    inc.load_lookback(late, path, "ts", at("2024-01-02 12:00:00"), 24)
    assert rows(spark.read.parquet(path), "id") == [(1,), (2,), (3,)]


# --- bookmarks ---------------------------------------------------------------------


def test_bookmark_modes(spark):
    root = scratch_path(spark, "bm")
    src = f"{root}/in"
    schema = spark.range(1).schema

    def run(mode="enable", context="default"):
        return run_bookmarked(spark, src, schema, f"{root}/out-{context}", root, "job", context, mode)

    spark.range(0, 10).write.mode("append").parquet(src)
    assert run() == 10
    assert run() == 0  # nothing new
    spark.range(10, 15).write.mode("append").parquet(src)
    assert run("pause") == 5 and run("pause") == 5  # the bookmark stays
    assert run() == 5 and run("pause") == 0
    assert run("disable") == 15
    assert run(context="other") == 15  # each context has its own bookmark
    assert run("reset") == 15 and run() == 0
    with pytest.raises(ValueError):
        run("stop")


# --- change capture ----------------------------------------------------------------

TARGET = [(1, "a", 1), (2, "b", 1), (3, "c", 1)]
CHANGES = [(2, "B", 5), (2, "BB", 6), (4, "D", 5), (4, "DD", 5)]


@pytest.fixture()
def change_data(spark):
    schema = "k int, v string, seq int"
    return spark.createDataFrame(TARGET, schema), spark.createDataFrame(CHANGES, schema)


ORDER = [("seq", False), ("v", False)]


def test_merge_takes_the_newest_change(change_data):
    target, changes = change_data
    assert rows(cdc.merge(target, changes, ["k"], ORDER), "k", "v") == [(1, "a"), (2, "BB"), (3, "c"), (4, "DD")]


def test_add_new_keys_leaves_known_keys_alone(change_data):
    target, changes = change_data
    assert rows(cdc.add_new_keys(target, changes, ["k"], ORDER), "k", "v") == [(1, "a"), (2, "b"), (3, "c"), (4, "DD")]


def test_metrics(change_data):
    target, changes = change_data
    stamped = changes.withColumn("seq", F.timestamp_seconds("seq").cast("timestamp_ntz"))
    got = cdc.change_metrics(target, stamped, ["k"], ORDER, "seq", at("1970-01-01 00:01:00")).first()
    assert tuple(got) == (1, 1, 2, 2, 54)


def test_upsert_partitions_moves_rows_and_leaves_others(spark):
    path = scratch_path(spark, "parts")
    schema = "k int, v string, p string"
    spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "z")], schema).write.partitionBy("p").parquet(path)
    in_z = lambda: [f for f in spark.read.parquet(path).inputFiles() if "/p=z/" in f]
    untouched = in_z()
    changes = spark.createDataFrame([(3, "C", "x"), (5, "E", "w")], schema)
    cdc.upsert_partitions(spark, path, changes, ["k"], [("v", False)], ["p"])
    got = spark.read.parquet(path)
    assert rows(got, "k", "v", "p") == [(1, "a", "x"), (2, "b", "x"), (3, "C", "x"), (4, "d", "z"), (5, "E", "w")]
    assert in_z() == untouched


def test_cdc_job_is_a_no_op_without_changes(spark):
    root = scratch_path(spark, "job")
    db = ensure_database(spark, "cdc_db", f"{root}/db")
    marks = inc.MarkStore(spark, f"{root}/marks")
    df = events(spark, (1, "2024-01-01 00:00:00"), (1, "2024-01-03 00:00:00"), (2, "2024-01-02 00:00:00"))
    assert cdc.run_cdc(spark, df, f"{db}.t", "ts", ["id"], marks)["changed"]
    assert not cdc.run_cdc(spark, df, f"{db}.t", "ts", ["id"], marks)["changed"]
    assert rows(spark.table(f"{db}.t"), "id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        cdc.run_cdc(spark, df, f"{db}.t", "ts", ["id"], marks, "replace")
