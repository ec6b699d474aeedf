"""CDC keeps every row: null and awkward partition values, emptied partitions, late ties."""

import pytest

from millrace.operators import cdc
from millrace.operators.incremental import MarkStore
from millrace.session import clear_scratch, scratch_path
from millrace.sources.files import ensure_database
from tests.conftest import rows

SCHEMA = "id int, p string, v int"


@pytest.mark.parametrize("start, change, want", [
    ([(1, None, 1), (2, None, 1)], [(1, None, 2)], [(1, None, 2), (2, None, 1)]),
    ([(1, "01", 1), (2, "01", 1)], [(1, "01", 2)], [(1, "01", 2), (2, "01", 1)]),
    ([(1, "a:b/c", 1), (2, "x%y", 1)], [(1, "new", 2), (2, None, 2)], [(1, "new", 2), (2, None, 2)]),
    ([(1, None, 1)], [(1, "z", 2)], [(1, "z", 2)]),
])
def test_partition_upsert_loses_and_repeats_nothing(spark, tmp_path, start, change, want):
    path = str(tmp_path / "t")
    spark.createDataFrame(start, SCHEMA).write.partitionBy("p").parquet(path)
    changes = spark.createDataFrame(change, SCHEMA)
    for _ in range(2):  # repeating it changes nothing
        cdc.upsert_partitions(spark, path, changes, ["id"], [("v", False)], ["p"])
        got = spark.read.schema("id int, v int, p string").parquet(path).select("id", "p", "v").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("strategy, want", [
    ("append", [(1, 5, 0), (2, 5, 0), (3, 6, 0)]),
    ("upsert", [(1, 5, 0), (2, 5, 0), (3, 6, 0)]),
    ("merge", [(1, 5, 0), (2, 5, 0), (3, 6, 0)]),
])
def test_a_change_at_the_mark_is_not_lost(spark, tmp_path, strategy, want):
    db = ensure_database(spark, f"late_{strategy}", str(tmp_path / "db"))
    try:
        marks = MarkStore(spark, str(tmp_path / "marks"))
        table = f"{db}.t"
        batches = [[(1, 5, 0)], [(1, 5, 0), (2, 5, 0)], [(1, 5, 0), (2, 5, 0), (3, 6, 0)]]
        for b in batches + batches[-1:]:
            out = cdc.run_cdc(spark, spark.createDataFrame(b, "id int, seq int, tie int"), table, "seq", ["id"], marks, strategy, [("tie", False)])
        assert not out["changed"]
        clear_scratch(spark)  # the table does not live there
        assert rows(spark.table(table)) == want
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_append_adds_files_and_rewrites_none(spark, tmp_path):
    db = ensure_database(spark, "adds", str(tmp_path / "db"))
    try:
        marks, table = MarkStore(spark, str(tmp_path / "marks")), f"{db}.t"
        source = spark.range(5).selectExpr("id", "id as seq")
        cdc.run_cdc(spark, source.where("seq < 3"), table, "seq", ["id"], marks, "append")
        before = {r[0] for r in spark.table(table).select("_metadata.file_path").distinct().collect()}
        cdc.run_cdc(spark, source, table, "seq", ["id"], marks, "append")
        after = {r[0] for r in spark.table(table).select("_metadata.file_path").distinct().collect()}
        assert before < after and spark.table(table).count() == 5
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_a_late_change_that_ties_with_a_newer_one_does_not_win(spark, tmp_path):
    db = ensure_database(spark, "ties", str(tmp_path / "db"))
    try:
        marks, table = MarkStore(spark, str(tmp_path / "marks")), f"{db}.t"
        for batch in ([(1, 5, 2)], [(1, 5, 1)]):
            cdc.run_cdc(spark, spark.createDataFrame(batch, "id int, seq int, tie int"), table, "seq", ["id"], marks, "upsert", [("tie", False)])
        assert rows(spark.table(table)) == [(1, 5, 2)]
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_states_before_the_last_two_are_deleted(spark, tmp_path):
    place = scratch_path(spark, "home")
    db = ensure_database(spark, "states", str(tmp_path / "db"))
    try:
        marks, table = MarkStore(spark, str(tmp_path / "marks")), f"{db}.t"
        for n in range(1, 5):
            cdc.run_cdc(spark, spark.range(n).selectExpr("id", "id as seq"), table, "seq", ["id"], marks, "upsert", location=place)
        import os

        assert len([f for f in os.listdir(place.removeprefix("file:")) if f.startswith("state-")]) == 2
        assert spark.table(table).count() == 4
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")
