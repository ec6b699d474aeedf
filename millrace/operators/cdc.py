"""Change data capture on plain files: upsert, append, deduplicating merge, metrics."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from pyspark.sql.types import StructType

from millrace.operators.incremental import MarkStore
from millrace.operators.joins import unmatched
from millrace.operators.windows import Order, latest_per_key
from millrace.session import materialize
from millrace.sources.files import write_table


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k] == right[k] for k in keys])


def latest_changes(changes: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """The newest change of each key (``order`` lists newest first)."""
    return latest_per_key(changes, keys, order)


def merge(target: DataFrame, changes: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """Target with matched rows replaced and new keys added.

    Only the newest change per key counts. Target rows without a change pass through one
    anti join on the distinct changed keys, spread over many tasks for hot keys.
    """
    newest = latest_changes(changes, keys, order).select(*target.columns)
    untouched = unmatched(target, changes, [(k, k) for k in keys])
    return untouched.unionByName(newest)


def append(target: DataFrame, changes: DataFrame) -> DataFrame:
    return target.unionByName(changes.select(*target.columns))


def add_new_keys(target: DataFrame, changes: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """Deduplicate the batch by key, then add only keys the target does not have."""
    newest = latest_changes(changes, keys, order).select(*target.columns)
    known = target.select(*keys).distinct()
    return target.unionByName(newest.join(known, same_keys(newest, known, keys), "left_anti"))


def change_metrics(
    target: DataFrame,
    changes: DataFrame,
    keys: list[str],
    order: Order,
    stamp: str,
    as_of: Column,
) -> DataFrame:
    """Inserted, updated, unchanged and conflicting keys, and the age of the newest change."""
    per_key = changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.max(stamp).alias("__newest")
    )
    old = target.select(*keys).distinct().withColumn("__old", F.lit(True))
    both = old.join(per_key, keys, "full")
    is_old, is_new = F.col("__old").isNotNull(), F.col("__n").isNotNull()
    return both.agg(
        F.count(F.when(~is_old & is_new, 1)).alias("inserted"),
        F.count(F.when(is_old & is_new, 1)).alias("updated"),
        F.count(F.when(is_old & ~is_new, 1)).alias("unchanged"),
        F.count(F.when(F.col("__n") > 1, 1)).alias("conflicts"),
        F.timestamp_diff("SECOND", F.max("__newest"), as_of).alias("freshness_seconds"),
    )


def upsert_partitions(
    spark: SparkSession,
    target_path: str,
    changes: DataFrame,
    keys: list[str],
    order: Order,
    partition_by: list[str],
    schema: StructType | None = None,
) -> None:
    """Upsert into a partitioned folder, rewriting only the partitions a change touches.

    ``schema`` declares the table, by default as the changes are; partition values are never
    inferred from folder names. Touched are the partitions the changes go to and those their
    old rows lie in, nulls included. The new content is written to the shared folder first;
    the second write replaces whole partitions, and files of partitions that lost all their
    rows are deleted last, so repeating the call after a failure gives the same table.
    """
    target = spark.read.schema(schema or changes.schema).parquet(target_path)
    columns = target.columns
    newest = materialize(latest_changes(changes, keys, order).select(*columns), "newest")
    changed = newest.select(*keys)
    was = target.join(changed, same_keys(target, changed, keys), "left_semi")
    touched = materialize(was.select(*partition_by).union(newest.select(*partition_by)).distinct(), "touched")
    # the folder a row lies in, as the file system names it: no value has to be escaped here
    folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1)
    placed = target.select(*columns, folder.alias("__folder"))
    in_scope = placed.join(touched, _same_values(placed, touched, partition_by), "left_semi")
    kept = in_scope.join(changed, same_keys(in_scope, changed, keys), "left_anti").select(*columns)
    fresh = materialize(kept.unionByName(newest), "partitions")
    filled = fresh.select(*partition_by).distinct()
    emptied = in_scope.join(filled, _same_values(in_scope, filled, partition_by), "left_anti")
    emptied = materialize(emptied.select("__folder").distinct(), "emptied")
    (
        fresh.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(target_path)
    )
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in emptied.toLocalIterator():  # a delete per partition that no longer exists
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(row["__folder"]))
        path.getFileSystem(conf).delete(path, True)


def _same_values(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality where null equals null, as partition values need it."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


STRATEGIES = ("upsert", "append", "merge")


def run_cdc(
    spark: SparkSession,
    source: DataFrame,
    table: str,
    cdc_column: str,
    keys: list[str],
    marks: MarkStore,
    strategy: str = "upsert",
    tie: Order | None = None,
    location: str | None = None,
) -> dict:
    """Apply the changes from the stored mark on to a catalog table, then store the new mark.

    Changes at the mark itself are read again: one that arrives late is applied, one that was
    applied before is found in the table and left out. ``append`` adds files for the new rows
    only. ``upsert`` and ``merge`` write the table's next state to a new folder below
    ``location`` (by default the table's place in its database), compare its row count with
    the count observed during the write and point the table to it; the state before the last
    is deleted. The mark moves last, so a run that dies is repeated with the same result.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    job = f"cdc:{table}"
    exists = spark.catalog.tableExists(table)
    mark = marks.get(job) if exists else None
    kind = source.schema[cdc_column].dataType
    changes = source
    if mark is not None:
        changes = source.where(F.col(cdc_column) >= F.lit(mark).cast(kind))
    # the largest change time is a column statistic in the files: a cheap first pass
    newest = changes.agg(F.max(cdc_column).cast("string")).first()[0]
    if newest is None:
        return {"changed": False, "mark": mark}
    changes = changes.where(F.col(cdc_column) <= F.lit(newest).cast(kind))
    order = [(cdc_column, False)] + (tie or [])
    home = (location or _default_location(spark, table)).rstrip("/")
    if mark is not None:
        target = spark.table(table)
        changes = _not_applied(target, changes.select(*target.columns), keys, order, strategy, cdc_column, F.lit(mark).cast(kind))
        changes = materialize(changes, "changes")
        if changes.isEmpty():
            return {"changed": False, "mark": mark}
    if strategy == "append":
        path = f"{home}/rows"
        # a first load replaces what a run left behind that died before it stored a mark
        _counted_write(spark, changes, path, "append" if mark is not None else "overwrite")
    else:
        if mark is None:
            fresh = latest_changes(changes, keys, order)
        elif strategy == "merge":
            fresh = add_new_keys(target, changes, keys, order)
        else:
            fresh = merge(target, changes, keys, order)
        path = f"{home}/state-{marks.runs(job):06d}-{uuid.uuid4().hex}"
        _counted_write(spark, fresh, path, "errorifexists")
    if exists:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{path}'")
    marks.set(job, newest)
    if strategy != "append":
        _drop_old_states(spark, home, keep=2)
    return {"changed": True, "mark": newest, "path": path}


def _default_location(spark: SparkSession, table: str) -> str:
    database, _, name = table.rpartition(".")
    root = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    return f"{root.rstrip('/')}/{name}"


def _not_applied(
    target: DataFrame, changes: DataFrame, keys: list[str], order: Order, strategy: str, cdc_column: str, mark: Column
) -> DataFrame:
    """Changes from the mark on without those the table already shows."""
    if strategy == "append":  # rows as often as they are missing
        return changes.exceptAll(target.where(F.col(cdc_column) >= mark))
    if strategy == "merge":
        known = target.select(*keys).distinct()
        return changes.join(known, same_keys(changes, known, keys), "left_anti")
    # against the table's own rows from the mark on, so that a late change that ties with a
    # newer one does not win
    since = target.where(F.col(cdc_column) >= mark)
    newest = latest_changes(changes.unionByName(since), keys, order)
    same = reduce(lambda a, b: a & b, [newest[c].eqNullSafe(since[c]) for c in target.columns])
    return newest.join(since, same, "left_anti")


def _counted_write(spark: SparkSession, df: DataFrame, path: str, mode: str) -> None:
    """Write rows and compare the number observed with the number that can be read."""
    before = spark.read.schema(df.schema).parquet(path).count() if mode == "append" else 0
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, mode=mode)
    landed = spark.read.schema(df.schema).parquet(path).count() - before  # from file footers
    if landed != seen.get["rows"]:
        raise RuntimeError(f"{path}: wrote {seen.get['rows']} rows but found {landed}")


def _drop_old_states(spark: SparkSession, home: str, keep: int) -> None:
    """Delete all but the newest ``keep`` states; a reader of the one before can finish."""
    root = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    states = sorted((f for f in files.listStatus(root) if f.getPath().getName().startswith("state-")), key=lambda f: f.getPath().getName())
    for old in states[:-keep]:
        files.delete(old.getPath(), True)
