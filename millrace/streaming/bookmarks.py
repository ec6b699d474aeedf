"""Jobs that process only input no earlier run has seen, kept by a streaming checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.operators.incremental import MarkStore
from millrace.session import scratch_path

MODES = ("enable", "disable", "pause", "reset")


def _copy_folder(spark: SparkSession, source: str, target: str) -> None:
    """Copy a checkpoint folder (small metadata files) on whatever file system it is on."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = src.getFileSystem(conf)
    if fs.exists(src):
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, dst.getFileSystem(conf), dst, False, conf)


def stream_etl(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    transform: str | None = None,
    run: str = "0",
) -> int:
    """Drain the new files of ``source`` into ``target``; returns the number of rows read.

    Each micro-batch overwrites its own folder, so a batch that is replayed after a
    failure is not written twice. ``transform`` is SQL over ``{source_table}``.
    """

    read: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("rows"))
        out = batch.sparkSession.sql(transform, source_table=counted) if transform else counted
        out.write.mode("overwrite").parquet(f"{target}/run={run}/batch={batch_id}")
        read.append(seen.get["rows"])

    query = (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(read)  # the progress log keeps the last batches only


def run_bookmarked(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    root: str,
    job: str,
    context: str = "default",
    mode: str = "enable",
    transform: str | None = None,
) -> int:
    """Load the files of ``source`` not yet seen under (job, context).

    ``enable`` goes on from the bookmark; ``reset`` drops it and reads everything again;
    ``pause`` reads the new files but leaves the bookmark where it is; ``disable`` reads
    everything without a bookmark.
    """
    if mode not in MODES:
        raise ValueError(f"unknown bookmark mode: {mode}")
    marks = MarkStore(spark, f"{root}/generations")
    name = f"{job}/{context}"
    generation = int(marks.get(name, "0"))
    if mode == "reset":
        generation += 1
        marks.set(name, str(generation))
    bookmark = f"{root}/bookmarks/{name}/{generation}"
    run = str(generation)
    if mode == "pause":
        copy = scratch_path(spark, "paused")
        _copy_folder(spark, bookmark, copy)
        bookmark, run = copy, "paused"
    if mode == "disable":
        bookmark, run = scratch_path(spark, "unmarked"), "unmarked"
    return stream_etl(spark, source, schema, target, bookmark, transform, run)
