"""Replay of a transaction log: last action wins, checkpoints, types from the log, refusals by name."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import delta_log as dl, files
from tests.conftest import rows

SCHEMA = "id int, v string, p date, q string"


def put(spark, table, name, data):
    """A file of (id, v), returned by its path below the table."""
    spark.createDataFrame(data, "id int, v string").coalesce(1).write.parquet(f"{table}/{name}")
    return name + "/" + next(n for n in dl._names(spark, f"{table}/{name}") if n.startswith("part-"))


def added(path, p=None, q=None, **more):
    return {"add": {"path": dl.escaped(path), "partitionValues": {"p": p, "q": q}, "size": 1, **more}}


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "a table")
    schema = spark.createDataFrame([], SCHEMA).schema
    one = put(spark, path, "p=2020-01-01/q=a b%25", [(1, "x"), (2, "y")])
    two = put(spark, path, "elsewhere", [(3, "z")])
    dl.write_commit(spark, path, 0, [{"protocol": {"minReaderVersion": 1}}, dl.metadata_of(schema, ["p", "q"]), added(one, "2020-01-01", "a b%"), added(two, "2021-05-05", "")])
    return path, one, two


FIRST = [(1, "x", "2020-01-01", "a b%"), (2, "y", "2020-01-01", "a b%"), (3, "z", "2021-05-05", None)]


def held(spark, path, version=None):
    return rows(dl.read_delta(spark, path, version).select("id", "v", F.col("p").cast("string"), "q"))


def test_values_and_types_come_from_the_log(spark, table):
    got = dl.read_delta(spark, table[0])
    assert got.schema.simpleString() == "struct<id:int,v:string,p:date,q:string>"
    assert held(spark, table[0]) == FIRST


def test_the_last_action_of_a_path_wins(spark, table):
    path, one, two = table
    dl.write_commit(spark, path, 1, [{"remove": {"path": dl.escaped(one)}}])
    assert held(spark, path) == FIRST[2:]
    dl.write_commit(spark, path, 2, [added(one, "2022-02-02", "n"), {"remove": {"path": dl.escaped(two)}}])
    assert held(spark, path) == [(1, "x", "2022-02-02", "n"), (2, "y", "2022-02-02", "n")]
    assert [held(spark, path, v) for v in (0, 1)] == [FIRST, FIRST[2:]]
    dl.write_commit(spark, path, 3, [{"remove": {"path": dl.escaped(one)}}, added(one, None, None)])  # both in one commit
    assert held(spark, path) == [(1, "x", None, None), (2, "y", None, None)]
    dl.write_commit(spark, path, 4, [{"remove": {"path": dl.escaped(one)}}])
    assert held(spark, path) == []


def test_replay_begins_at_the_newest_whole_checkpoint(spark, table, tmp_path):
    path, one, two = table
    dl.write_commit(spark, path, 1, [{"remove": {"path": dl.escaped(one)}}])
    dl.write_checkpoint(spark, path, 1)
    three = put(spark, path, "three", [(9, "n")])
    dl.write_commit(spark, path, 2, [added(three, "2020-01-01", "c")])
    want = [FIRST[2], (9, "n", "2020-01-01", "c")]
    for v in (0, 1):  # commits before the checkpoint may be gone
        (tmp_path / "a table" / "_delta_log" / f"{v:020d}.json").unlink()
    assert held(spark, path) == sorted(want)
    # a checkpoint in parts that lacks one is passed over
    (tmp_path / "a table" / "_delta_log" / f"{2:020d}.checkpoint.{1:010d}.{2:010d}.parquet").write_bytes(b"")
    assert held(spark, path) == sorted(want)
    (tmp_path / "a table" / "_delta_log" / f"{4:020d}.json").write_text("{}")
    with pytest.raises(dl.BrokenLog, match="commit 3"):
        held(spark, path)


def test_a_column_added_later_is_null_in_old_files(spark, table):
    path = table[0]
    schema = spark.createDataFrame([], SCHEMA + ", extra double").schema
    dl.write_commit(spark, path, 1, [dl.metadata_of(schema, ["p", "q"])])
    assert {r.extra for r in dl.read_delta(spark, path).collect()} == {None}


@pytest.mark.parametrize(
    "action, named",
    [
        ({"protocol": {"minReaderVersion": 3, "readerFeatures": ["v2Checkpoint"]}}, "v2Checkpoint"),
        ({"protocol": {"minReaderVersion": 3, "readerFeatures": ["typeWidening", "timestampNtz"]}}, "typeWidening"),
        ({"protocol": {"minReaderVersion": 4, "readerFeatures": []}}, "reader version 4"),
    ],
)
def test_unknown_features_are_refused_by_name(spark, table, action, named):
    dl.write_commit(spark, table[0], 1, [action])
    with pytest.raises(dl.UnsupportedFeature, match=named):
        dl.read_delta(spark, table[0])


def test_deletion_vectors_and_column_mapping(spark, table):
    path, one, two = table
    dl.write_commit(spark, path, 1, [{"protocol": {"minReaderVersion": 3, "readerFeatures": ["deletionVectors", "columnMapping"]}}])
    assert held(spark, path) == FIRST  # allowed for, not used
    dl.write_commit(spark, path, 2, [added(two, "2021-05-05", "", deletionVector={"storageType": "u"})])
    with pytest.raises(dl.UnsupportedFeature, match="deletionVectors"):
        dl.read_delta(spark, path)
    meta = dl.metadata_of(spark.createDataFrame([], SCHEMA).schema, ["p", "q"])
    meta["metaData"]["configuration"] = {"delta.columnMapping.mode": "name"}
    dl.write_commit(spark, path, 3, [meta])
    with pytest.raises(dl.UnsupportedFeature, match="columnMapping"):
        dl.read_delta(spark, path)


def test_no_log_no_table(spark, tmp_path):
    with pytest.raises(dl.BrokenLog):
        dl.read_delta(spark, str(tmp_path / "none"))
    (tmp_path / "t" / "_delta_log").mkdir(parents=True)
    (tmp_path / "t" / "_delta_log" / f"{0:020d}.json").write_text(json.dumps({"protocol": {"minReaderVersion": 1}}))
    with pytest.raises(dl.BrokenLog, match="no schema"):
        dl.read_delta(spark, str(tmp_path / "t"))


def test_the_reader_of_formats_replays_the_log(spark, table):
    got = files.read_table(spark, table[0], "delta")
    assert rows(got.select("id", "v", F.col("p").cast("string"), "q")) == FIRST
