"""Session settings and the shared scratch folder used by every operator."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Skewed join partitions are split by
# adaptive execution; "force" lets it split even where that costs one more shuffle.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # whole documents go to Python in these batches; ten thousand would be hundreds of MB
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

BYTES_PER_SHUFFLE_PARTITION = 512 * 1024 * 1024  # of input; columns are pruned before a shuffle
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # drop shuffle files when a query ends
SMALL_SHARE = 4 * 1024 * 1024  # bytes per core that Spark does not split any further

_local_roots: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to a session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may run without it; then a fresh temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="millrace-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the application's scratch folder that no earlier call has returned."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/millrace/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to its scratch folder.

    Call it when no frame made by the library is needed any more.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and fixes values that depend on
    how rows were partitioned (slice numbers, range boundaries). Unlike an RDD
    checkpoint the copy is columnar, so later reads prune columns. The shuffle files of the
    write are dropped with it: the copy takes their place.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(written: DataFrame) -> None:
    """Delete a frame that ``materialize`` wrote; nothing may depend on it any more but through written frames."""
    files = written.inputFiles()
    if not files:
        return
    spark = written.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(files[0])).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def plan_bytes(df: DataFrame) -> int:
    """Size the optimizer knows for a frame (file bytes for a scan), without running a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions a shuffle starts with, before adaptive execution merges small ones."""
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    return int(spark.conf.get(key, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Let shuffles start with enough partitions for an input of this size.

    Only ever raises the number the session was given; adaptive execution merges what turns
    out too small.
    """
    wanted = math.ceil(input_bytes / BYTES_PER_SHUFFLE_PARTITION)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a folder, as its file system reports them."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return file_system.getContentSummary(hadoop_path).getLength()


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a frame too small to be split by its bytes.

    For work that costs much more per row than reading it. A frame of ordinary size has
    enough partitions and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < cores * SMALL_SHARE else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on any file system Spark can read."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
