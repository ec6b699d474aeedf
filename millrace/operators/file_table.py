"""A keyed table of Parquet files under a manifest: merges rewrite only files that hold a changed key.

    <root>/data/<write>/part-*.parquet     written once, never changed
    <root>/manifests/v000000012.json       the files of one state, with rows and key ranges

A state is its manifest. A merge writes new files first and then the next manifest, under a name no other
writer can take: renaming a finished file onto a name that exists fails. Whatever dies before that leaves the
state as it was, with files no manifest names; ``vacuum`` deletes those. A manifest also carries what must
change together with the rows: the mark of a change job and the last batch of each stream, so a batch that is
repeated is recognised.

The driver handles the list of files (paths, counts, ranges), never rows. Key ranges leave out files before
any is read; of the rest, the key columns alone tell which hold a changed key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.operators.hotkeys import spread_join
from millrace.operators.joins import unmatched
from millrace.operators.windows import Order, latest_per_key
from millrace.session import materialize, path_exists


class Conflict(RuntimeError):
    """Another writer has made the next state first."""


@dataclass(frozen=True)
class DataFile:
    path: str  # below the table's folder
    rows: int
    low: str | None  # least and largest first key, as text; null: no row has one
    high: str | None


@dataclass(frozen=True)
class State:
    version: int = 0
    files: tuple[DataFile, ...] = ()
    mark: str | None = None
    batches: dict[str, int] = field(default_factory=dict)  # stream -> last batch


class FileTable:
    """The table below ``root``. ``keys`` identify a row; null keys are ordinary values that match nothing."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], file_rows: int = 1_000_000):
        self.spark, self.root, self.schema, self.keys, self.file_rows = spark, root.rstrip("/"), schema, keys, file_rows

    # --- states ------------------------------------------------------------------------------

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def versions(self) -> list[int]:
        folder = f"{self.root}/manifests"
        if not path_exists(self.spark, folder):
            return []
        fs, path = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/v{version:09d}.json"

    def state(self, version: int | None = None) -> State:
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return State()
        fs, path = self._fs(self._manifest(version))
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        raw = json.loads(text)
        return State(version, tuple(DataFile(**f) for f in raw["files"]), raw["mark"], raw["batches"])

    def _commit(self, state: State) -> None:
        """Make ``state`` the newest one, or fail if its version exists."""
        content = {"files": [f.__dict__ for f in state.files], "mark": state.mark, "batches": state.batches}
        part = f"{self.root}/manifests/_{uuid.uuid4().hex}"
        fs, path = self._fs(part)
        stream = fs.create(path, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        target = self._fs(self._manifest(state.version))[1]
        if fs.exists(target) or not fs.rename(path, target):
            fs.delete(path, False)
            raise Conflict(f"state {state.version} of {self.root} exists")

    # --- reading -----------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.state(version).files)

    def _read(self, files) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f.path}" for f in files])

    # --- writing -----------------------------------------------------------------------------

    def _write(self, rows: DataFrame) -> tuple[DataFile, ...]:
        """New files of ``rows``, in ranges of the first key; their counts and ranges are read from them."""
        rows = materialize(rows.select(*self.schema.names), "merged")
        total = rows.count()  # from file footers
        if not total:
            return ()
        name = f"data/{uuid.uuid4().hex}"
        ranged = rows.repartitionByRange(-(-total // self.file_rows), *self.keys).sortWithinPartitions(*self.keys)
        ranged.write.option("maxRecordsPerFile", self.file_rows).parquet(f"{self.root}/{name}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}")
        first = F.col(self.keys[0])
        found = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(
            F.count(F.lit(1)).alias("n"), F.min(first).cast("string").alias("low"), F.max(first).cast("string").alias("high")
        )
        return tuple(DataFile(f"{name}/{r.file}", r.n, r.low, r.high) for r in sorted(found.collect()))

    def create(self, rows: DataFrame, mark: str | None = None) -> State:
        """The first state."""
        state = State(1, self._write(rows), mark)
        self._commit(state)
        return state

    def _in_range(self, files, changes: DataFrame) -> list[DataFile]:
        """Files whose range of the first key can hold one of the changes' keys, compared in the key's own type."""
        if not files:
            return []
        kind = self.schema[self.keys[0]].dataType
        ranges = self.spark.createDataFrame([(i, f.low, f.high) for i, f in enumerate(files)], "i int, low string, high string")
        ranges = ranges.select("i", F.col("low").cast(kind).alias("low"), F.col("high").cast(kind).alias("high"))
        ends = changes.agg(F.struct(F.min(self.keys[0]).alias("low"), F.max(self.keys[0]).alias("high"))).scalar()
        meets = (F.col("low") <= ends["high"]) & (F.col("high") >= ends["low"])
        return [files[r.i] for r in ranges.where(meets).select("i").collect()]

    def touched(self, state: State, changed: DataFrame) -> list[DataFile]:
        """Files that hold a key of ``changed``, a row per key under the names ``__k0``, ``__k1``, ..."""
        names = [f"__k{i}" for i in range(len(self.keys))]
        near = self._in_range(state.files, changed.toDF(*self.keys))
        if not near:
            return []
        held = self._read(near).select(*self.keys, F.col("_metadata.file_path").alias("__file"))
        hits = spread_join(held, changed, list(zip(self.keys, names, strict=True)), "left_semi", right_unique=True)
        hit = {r["__file"] for r in hits.select("__file").distinct().collect()}  # paths of files
        return [f for f in near if any(p.endswith(f"/{f.path}") for p in hit)]

    def _next(self, state: State, changes: DataFrame, replaced: bool, **together) -> State:
        """Write ``changes`` (a row per key); ``replaced``: rows of these keys give way, else stay and win."""
        names = [f"__k{i}" for i in range(len(self.keys))]
        changes = materialize(changes.select(*self.schema.names), "changes")
        changed = changes.select(*[F.col(k).alias(n) for k, n in zip(self.keys, names, strict=True)])
        pairs = list(zip(self.keys, names, strict=True))
        if replaced:
            old = self.touched(state, changed)
            stays = [f for f in state.files if f not in old]
            fresh = unmatched(self._read(old), changed, pairs).unionByName(changes) if old else changes
        else:
            near = self._in_range(state.files, changes)
            known = self._read(near).select(*[F.col(k).alias(n) for k, n in zip(self.keys, names, strict=True)])
            stays, fresh = list(state.files), unmatched(changes, known, pairs) if near else changes
        made = replace(state, version=state.version + 1, files=(*stays, *self._write(fresh)), **together)
        self._commit(made)
        return made

    def upsert(self, changes: DataFrame, order: Order, **together) -> State:
        """Rows of changed keys are replaced by the newest change, new keys added."""
        return self._next(self.state(), latest_per_key(changes, self.keys, order), True, **together)

    def add_new(self, changes: DataFrame, order: Order, **together) -> State:
        """New keys are added with their newest change; rows of known keys stay. No file is rewritten."""
        return self._next(self.state(), latest_per_key(changes, self.keys, order), False, **together)

    def compact(self, below_rows: int | None = None) -> State:
        """Put files of fewer rows than ``below_rows`` (half a file by default) together."""
        state = self.state()
        small = [f for f in state.files if f.rows < (below_rows or self.file_rows // 2)]
        if len(small) < 2:
            return state
        made = replace(state, version=state.version + 1, files=(*[f for f in state.files if f not in small], *self._write(self._read(small))))
        self._commit(made)
        return made

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests before the last ``keep`` and files that no kept one names; returns the files."""
        versions = self.versions()
        kept = versions[-keep:]
        named = {f.path for v in kept for f in self.state(v).files}
        for v in versions[:-keep]:
            fs, path = self._fs(self._manifest(v))
            fs.delete(path, False)
        gone = []
        fs, folder = self._fs(f"{self.root}/data")
        if not fs.exists(folder):
            return gone
        for write in fs.listStatus(folder):
            listed = [s.getPath() for s in fs.listStatus(write.getPath())]
            data = {f"data/{write.getPath().getName()}/{p.getName()}": p for p in listed if p.getName().startswith("part-")}
            if not named & set(data):
                fs.delete(write.getPath(), True)
                gone += sorted(data)
                continue
            for name in sorted(set(data) - named):
                fs.delete(data[name], False)
                gone.append(name)
        return gone


def apply_changes(table: FileTable, source: DataFrame, cdc_column: str, order: Order | None = None, strategy: str = "upsert") -> State:
    """Apply the changes from the table's mark on; the new mark is part of the new state.

    Changes at the mark itself are read again, as one may have come late. ``upsert`` lets a change win only if
    the table does not show a newer one of its key; ``merge`` only adds keys.
    """
    if strategy not in ("upsert", "merge"):
        raise ValueError(f"unknown strategy: {strategy}")
    state = table.state()
    kind = table.schema[cdc_column].dataType
    changes = source if state.mark is None else source.where(F.col(cdc_column) >= F.lit(state.mark).cast(kind))
    newest = changes.agg(F.max(cdc_column).cast("string")).first()[0]
    if newest is None:
        return state
    changes = changes.where(F.col(cdc_column) <= F.lit(newest).cast(kind)).select(*table.schema.names)
    by_time = [(cdc_column, False), *(order or [])]
    if strategy == "merge":
        if state.mark is not None and unmatched(changes, table.read().select(*[F.col(k).alias(f"__k_{k}") for k in table.keys]), [(k, f"__k_{k}") for k in table.keys]).isEmpty():
            return state
        made = table.add_new(changes, by_time, mark=newest)
    else:
        if state.mark is not None:  # what the table shows from the mark on takes part, so ties do not undo it
            since = table.read().where(F.col(cdc_column) >= F.lit(state.mark).cast(kind))
            latest = latest_per_key(changes.unionByName(since), table.keys, by_time)
            changes = materialize(latest.exceptAll(since), "changes")
            if changes.isEmpty():
                return state
        made = table.upsert(changes, by_time, mark=newest)
    table.vacuum()
    return made


def stream_into(table: FileTable, changes: DataFrame, name: str, order: Order, checkpoint: str, **options):
    """A streaming query that upserts each micro-batch once, also if it is repeated after a failure.

    The state that a batch makes carries the batch's number under ``name``; a batch of that number or a lower
    one is left out. ``options`` go to the trigger, by default all that is there.
    """

    def one(batch: DataFrame, number: int) -> None:
        state = table.state()
        if state.batches.get(name, -1) >= number:
            return
        table.upsert(batch, order, batches={**state.batches, name: number})

    writer = changes.writeStream.foreachBatch(one).queryName(name).option("checkpointLocation", checkpoint)
    return writer.trigger(**(options or {"availableNow": True})).start()
