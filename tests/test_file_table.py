"""Merges by touched files: right rows, few rewritten files, states that survive a stop, repeated batches."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import cdc
from millrace.operators.file_table import Conflict, FileTable, apply_changes, stream_into
from tests.conftest import rows

SCHEMA = "id int, v int, t int"
NEWEST = [("t", False), ("v", False)]


def table_of(spark, path, n=1000, file_rows=100):
    df = spark.range(n).selectExpr("cast(id as int) id", "0 v", "0 t")
    table = FileTable(spark, str(path), df.schema, ["id"], file_rows)
    table.create(df)
    return table


def test_only_files_with_a_changed_key_are_rewritten(spark, tmp_path):
    table = table_of(spark, tmp_path / "t")
    before = table.state()
    assert len(before.files) == 10 and sum(f.rows for f in before.files) == 1000
    # one percent of the keys, all in two files, and new keys
    changes = spark.createDataFrame([(i, 1, 1) for i in [*range(120, 125), *range(730, 735), 5000]], SCHEMA)
    after = table.upsert(changes, NEWEST)
    assert len(set(before.files) - set(after.files)) == 2
    want = cdc.merge(table.read(1), changes, ["id"], NEWEST)
    assert rows(table.read()) == rows(want)
    # the old state can still be read
    assert rows(table.read(1).agg(F.sum("v"), F.count(F.lit(1)))) == [(0, 1000)]


def test_a_key_between_the_keys_of_a_file_rewrites_nothing(spark, tmp_path):
    df = spark.range(0, 1000, 2).selectExpr("cast(id as int) id", "0 v", "0 t")
    table = FileTable(spark, str(tmp_path / "t"), df.schema, ["id"], 100)
    before = table.create(df)
    after = table.upsert(spark.createDataFrame([(301, 1, 1)], SCHEMA), NEWEST)
    assert set(before.files) <= set(after.files) and table.read().count() == 501


@pytest.mark.parametrize("stop", ["_write", "_commit"])
def test_a_merge_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch, stop):
    table = table_of(spark, tmp_path / "t")
    before, old = table.state(), rows(table.read())
    changes = spark.createDataFrame([(5, 1, 1), (2000, 1, 1)], SCHEMA)
    real = getattr(FileTable, stop)

    def dies(self, *args):
        if stop == "_write":
            real(self, *args)
        raise OSError("lost")

    monkeypatch.setattr(FileTable, stop, dies)
    with pytest.raises(OSError):
        table.upsert(changes, NEWEST)
    monkeypatch.undo()
    assert table.state() == before and rows(table.read()) == old
    orphans = table.vacuum()
    assert orphans and rows(table.read()) == old
    table.upsert(changes, NEWEST)  # and the repeated merge works
    assert table.read().where("v = 1").count() == 2


def test_two_writers_of_one_state_conflict(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", 10)
    state = table.state()
    change = spark.createDataFrame([(5, 1, 1)], SCHEMA)
    table._next(state, change, True)
    with pytest.raises(Conflict):
        table._next(state, change, True)
    assert table.versions() == [1, 2]


def test_vacuum_and_compaction_keep_the_rows(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", 300)
    for n in range(4):
        table.upsert(spark.createDataFrame([(1000 + n, n, 1)] + [(n, 7, 1)] * (n == 0), SCHEMA), NEWEST)
    want = rows(table.read())
    many = len(table.state().files)
    assert len(table.compact(50).files) < many
    table.vacuum(keep=1)
    assert rows(table.read()) == want and len(table.versions()) == 1
    on_disk = [f for _, _, fs in os.walk(tmp_path / "t" / "data") for f in fs if f.startswith("part-")]
    assert len(on_disk) == len(table.state().files)


@pytest.mark.parametrize("kind, keys", [("string", ["b", "a", None]), ("date", ["2020-01-02", "2021-01-01", None]), ("int", ["2", "10", None])])
def test_keys_of_other_types_and_nulls(spark, tmp_path, kind, keys):
    df = spark.createDataFrame([(k, 0) for k in keys], "k string, v int").select(F.col("k").cast(kind).alias("k"), "v")
    table = FileTable(spark, str(tmp_path / "t"), df.schema, ["k"], 1)
    table.create(df)
    change = df.where(F.col("k").isNull() | (F.col("k") == F.lit(keys[1]).cast(kind))).withColumn("v", F.lit(1))
    table.upsert(change, [("v", False)])
    got = {(str(r.k), r.v) for r in table.read().collect()}
    # a null key equals no other: the old row stays and the new one is added
    assert got == {(keys[0], 0), (keys[1], 1), ("None", 0), ("None", 1)}
    empty = FileTable(spark, str(tmp_path / "e"), df.schema, ["k"])
    empty.create(df.limit(0))
    assert empty.read().count() == 0
    empty.upsert(df, [("v", False)])
    assert empty.read().count() == 3


@pytest.mark.parametrize("strategy, want", [("upsert", [(1, 5, 0), (2, 5, 0), (3, 6, 0)]), ("merge", [(1, 5, 0), (2, 5, 0), (3, 6, 0)])])
def test_changes_at_the_mark_are_applied_once(spark, tmp_path, strategy, want):
    df = spark.createDataFrame([], "id int, seq int, tie int")
    table = FileTable(spark, str(tmp_path / "t"), df.schema, ["id"])
    for b in [[(1, 5, 0)], [(1, 5, 0), (2, 5, 0)], [(1, 5, 0), (2, 5, 0), (3, 6, 0)]]:
        apply_changes(table, spark.createDataFrame(b, df.schema), "seq", [("tie", False)], strategy)
    version = table.state().version
    apply_changes(table, spark.createDataFrame(b, df.schema), "seq", [("tie", False)], strategy)
    assert table.state().version == version and table.state().mark == "6"
    assert rows(table.read()) == want


def test_a_late_tie_does_not_win(spark, tmp_path):
    schema = spark.createDataFrame([], "id int, seq int, tie int").schema
    table = FileTable(spark, str(tmp_path / "t"), schema, ["id"])
    for b in ([(1, 5, 2)], [(1, 5, 1)]):
        apply_changes(table, spark.createDataFrame(b, schema), "seq", [("tie", False)])
    assert rows(table.read()) == [(1, 5, 2)]


def test_a_killed_and_restarted_stream_equals_one_batch(spark, tmp_path, monkeypatch):
    source, schema = str(tmp_path / "in"), "id int, v int, t int"
    table = table_of(spark, tmp_path / "t", 50, 10)

    def add(n, batch):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)

    batches = [[(1, 1, 1), (60, 1, 1)], [(1, 2, 2), (61, 1, 2)], [(2, 9, 3), (60, 4, 3)]]
    add(0, batches[0])
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_into(table, changes, "orders", NEWEST, str(tmp_path / "c")).awaitTermination()
    # the second batch is applied, but the stream dies before it can note that
    add(1, batches[1])
    real = FileTable.upsert

    def dies_late(self, *args, **kwargs):
        real(self, *args, **kwargs)
        raise OSError("lost")

    monkeypatch.setattr(FileTable, "upsert", dies_late)
    with pytest.raises(Exception):
        stream_into(table, changes, "orders", NEWEST, str(tmp_path / "c")).awaitTermination()
    monkeypatch.undo()
    version = table.state().version
    add(2, batches[2])
    stream_into(table, changes, "orders", NEWEST, str(tmp_path / "c")).awaitTermination()
    assert table.state().version == version + 1  # the repeated batch made no state
    whole = table_of(spark, tmp_path / "one", 50, 10)
    whole.upsert(spark.createDataFrame([r for b in batches for r in b], schema), NEWEST)
    assert rows(table.read()) == rows(whole.read())
