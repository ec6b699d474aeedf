"""Tables with a transaction log, read by replaying the log: no module beyond Spark is needed.

    <table>/_delta_log/00000000000000000012.json            the actions of one commit, a JSON object per line
    <table>/_delta_log/00000000000000000010.checkpoint.parquet   all actions up to a commit, also in parts

Replay takes the newest whole checkpoint and the commits after it; of each path the last action wins, and
what was added and not removed since is the table. The schema, the partition columns and their types come
from the last metadata action, values of partition columns from the log, never from folder names.

The log is read and replayed as a frame. The driver gets the names of the log's files, the one protocol and
metadata action, and the paths of the files to read, as a scan needs them; never rows of the table. Partition
values reach the rows by a join on the file's path.

A table that asks for a reader feature that is not known here is refused by that feature's name.
"""

from __future__ import annotations

import json
import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.session import path_exists

# Fixed values of the format: the reader version all tables can ask for, and features that change nothing
# for a reader of whole files.
READER_VERSION = 1
HARMLESS_FEATURES = {"timestampNtz", "vacuumProtocolCheck"}
ACTIONS = """
    add struct<path: string, partitionValues: map<string, string>, size: bigint, deletionVector: struct<storageType: string>>,
    remove struct<path: string>,
    metaData struct<schemaString: string, partitionColumns: array<string>, configuration: map<string, string>>,
    protocol struct<minReaderVersion: int, readerFeatures: array<string>>
"""
_COMMIT = re.compile(r"^(\d{20})\.json$")
_CHECKPOINT = re.compile(r"^(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet$")


class UnsupportedFeature(RuntimeError):
    """The table needs a reader feature that this replay does not know."""


class BrokenLog(RuntimeError):
    """Commits are missing, or the log has no schema."""


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def log_files(names: list[str], version: int | None = None) -> tuple[list[str], list[str], int]:
    """(checkpoint files, commit files, version) that make up a version, the newest by default."""
    commits = {int(m[1]): n for n in names if (m := _COMMIT.match(n))}
    checkpoints: dict[int, dict] = {}
    for n in names:
        if m := _CHECKPOINT.match(n):
            checkpoints.setdefault(int(m[1]), {}).setdefault(int(m[3] or 1), []).append(n)
    newest = max([*commits, *checkpoints], default=-1)
    version = newest if version is None else version
    if not 0 <= version <= newest:
        raise BrokenLog(f"version {version} is not in the log")
    base, start = [], -1
    for at in sorted((v for v in checkpoints if v <= version), reverse=True):
        whole = [files for parts, files in checkpoints[at].items() if len(files) == parts]
        if whole:  # one that lacks a part is passed over
            base, start = sorted(whole[0]), at
            break
    missing = [v for v in range(start + 1, version + 1) if v not in commits]
    if missing:
        raise BrokenLog(f"commit {missing[0]} is missing from the log")
    return base, [commits[v] for v in range(start + 1, version + 1)], version


def actions(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """(version, add, remove, metaData, protocol) of the log's files."""
    folder = f"{table.rstrip('/')}/_delta_log"
    if not path_exists(spark, folder):
        raise BrokenLog(f"{table} has no log")
    base, commits, _ = log_files(_names(spark, folder), version)
    schema = StructType.fromDDL(ACTIONS)
    number = F.regexp_extract("_metadata.file_name", r"^(\d{20})", 1).cast("bigint").alias("version")
    parts = []
    if commits:
        parts.append(spark.read.schema(schema).json([f"{folder}/{n}" for n in commits]).select(number, *schema.names))
    if base:
        parts.append(spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in base]).select(number, *schema.names))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def live_files(log: DataFrame) -> DataFrame:
    """(path, partitionValues, size, deletionVector): files whose last action adds them.

    Within a commit, a path that is removed and added again is there.
    """
    touched = log.where("add is not null or remove is not null").select(
        F.coalesce("add.path", "remove.path").alias("path"), F.struct("version", F.col("add").isNotNull().alias("added")).alias("at"), "add"
    )
    last = touched.groupBy("path").agg(F.max_by("add", "at").alias("add"))
    return last.where("add is not null").select("add.*")


def _check(spark: SparkSession, log: DataFrame) -> tuple[StructType, list[str]]:
    """The table's schema and partition columns, or a refusal."""
    found = log.agg(
        F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("version"))).alias("meta"),
        F.max_by("protocol", F.when(F.col("protocol").isNotNull(), F.col("version"))).alias("protocol"),
    ).first()
    if found.meta is None:
        raise BrokenLog("the log has no schema")
    if found.protocol is not None and found.protocol.minReaderVersion > READER_VERSION:
        asked = set(found.protocol.readerFeatures or ())
        if found.protocol.minReaderVersion == 2:
            asked.add("columnMapping")
        mapping = (found.meta.configuration or {}).get("delta.columnMapping.mode", "none")
        unknown = asked - HARMLESS_FEATURES - ({"columnMapping"} if mapping == "none" else set()) - {"deletionVectors"}
        if unknown:
            raise UnsupportedFeature(f"reader features not supported: {', '.join(sorted(unknown))}")
        if found.protocol.minReaderVersion > 3:
            raise UnsupportedFeature(f"reader version {found.protocol.minReaderVersion} is not supported")
    return StructType.fromJson(json.loads(found.meta.schemaString)), list(found.meta.partitionColumns or [])


def _place(uri: Column) -> Column:
    """A file's place: escapes undone (a plus sign is none), one spelling of local paths."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def _root(spark: SparkSession, table: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:/", whole)


def read_delta(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The table at a version, the newest by default, with the columns and types of its last schema.

    Files of an older schema lack columns, which are null. A file with a deletion vector is refused, since
    some of its rows are gone; tables that only allow for such files are read.
    """
    table = table.rstrip("/")
    log = actions(spark, table, version)
    schema, partitions = _check(spark, log)
    absolute = F.col("path").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:/")
    at_home = F.concat(F.lit(_root(spark, table)), F.lit("/"), _place(F.col("path")))
    live = live_files(log).withColumn("place", F.when(absolute, _place(F.col("path"))).otherwise(at_home))
    files = live.select("place", F.col("deletionVector").isNotNull().alias("cut")).collect()  # the paths a scan is given
    if any(f.cut for f in files):
        raise UnsupportedFeature("reader features not supported: deletionVectors")
    if not files:
        return spark.createDataFrame([], schema)
    stored = StructType([f for f in schema.fields if f.name not in partitions])
    # folder names are not read for values
    rows = spark.read.schema(stored).option("recursiveFileLookup", True).parquet(*[f.place for f in files])
    if not partitions:
        return rows
    value = [F.try_element_at("partitionValues", F.lit(p)) for p in partitions]
    # an empty string stands for null, as partition values have no other way to say it
    typed = [F.when(v != "", v).cast(schema[p].dataType).alias(p) for v, p in zip(value, partitions, strict=True)]
    rows = rows.withColumn("__file", _place(F.col("_metadata.file_path")))
    joined = rows.join(live.select("place", *typed), F.col("__file") == F.col("place"))
    return joined.select(*[F.col(f"`{n}`") for n in schema.names])


def escaped(path: str) -> str:
    """A relative path as the log spells it."""
    return quote(path, safe="/=:@!$&'()*+,;-._~")


def _put(spark: SparkSession, path: str, text: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_commit(spark: SparkSession, table: str, version: int, entries: list[dict]) -> None:
    """One commit file of actions; fails if the version exists."""
    _put(spark, f"{table.rstrip('/')}/_delta_log/{version:020d}.json", "".join(json.dumps(e) + "\n" for e in entries))


def metadata_of(schema: StructType, partitions: list[str]) -> dict:
    return {"metaData": {"schemaString": schema.json(), "partitionColumns": partitions, "configuration": {}}}


def write_checkpoint(spark: SparkSession, table: str, version: int) -> None:
    """All actions up to a version that still count, as one file that replay can begin with."""
    table = table.rstrip("/")
    log = actions(spark, table, version)
    _check(spark, log)
    schema = StructType.fromDDL(ACTIONS)
    last = [
        log.where(F.col(c).isNotNull()).orderBy(F.desc("version")).limit(1).select(*[F.col(n) if n == c else F.lit(None).cast(schema[n].dataType).alias(n) for n in schema.names])
        for c in ("protocol", "metaData")
    ]
    adds = live_files(log).select(F.struct("*").cast(schema["add"].dataType).alias("add"))
    adds = adds.select(*[F.col(n) if n == "add" else F.lit(None).cast(schema[n].dataType).alias(n) for n in schema.names])
    folder = f"{table}/_delta_log/_checkpoint-{version}"
    last[0].unionByName(last[1]).unionByName(adds).repartition(1).write.parquet(folder)  # rows of the log, not of the table
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in files.listStatus(hadoop.Path(folder)) if s.getPath().getName().startswith("part-"))
    files.rename(part, hadoop.Path(f"{table}/_delta_log/{version:020d}.checkpoint.parquet"))
    files.delete(hadoop.Path(folder), True)
