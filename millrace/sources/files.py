"""Reading and writing tables in the supported formats."""

from __future__ import annotations

from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.session import path_exists
from millrace.sources.delta_log import read_delta

BUILT_IN_FORMATS = ("parquet", "csv", "json", "orc")
EXTRA_FORMATS = ("avro", "delta")  # need a module that is not part of the Spark distribution

# Default write codec per format (fixed values).
WRITE_CODEC = {"parquet": "snappy", "orc": "zlib", "csv": "gzip", "json": "gzip"}

# CSV that comes back as it was written: quotes doubled, backslashes plain, line breaks and outer
# blanks kept. A null is an empty field and an empty string a quoted one; the reader tells them
# apart only if its mark for null is something else than the empty string.
CSV_BOTH = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_READ = {**CSV_BOTH, "multiLine": True, "nullValue": "\u0001", "emptyValue": ""}
CSV_WRITE = {**CSV_BOTH, "nullValue": "", "emptyValue": '""', "escapeQuotes": True}


class MissingFormat(RuntimeError):
    """The data source of a format is not on the classpath."""


@contextmanager
def _named_if_missing(fmt: str):
    """Turn Spark's "no such data source" into a message that says what to add."""
    try:
        yield
    except (AnalysisException, Py4JJavaError) as err:
        missing = any(m in str(err) for m in ("DATA_SOURCE_NOT_FOUND", "Failed to find", "AVRO_NOT_LOADED"))
        if fmt in EXTRA_FORMATS and missing:
            raise MissingFormat(
                f"format '{fmt}' is not available: add its Spark module to the session"
            ) from err
        raise


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    **options,
) -> DataFrame:
    """Load files of any supported format; CSV has a header row, bad JSON rows are dropped."""
    if fmt not in BUILT_IN_FORMATS + EXTRA_FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV_READ)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if fmt == "json":
        reader = reader.option("mode", "DROPMALFORMED")
    for name, value in options.items():
        reader = reader.option(name, value)
    try:
        with _named_if_missing(fmt):
            return reader.load(path)
    except MissingFormat:
        if fmt != "delta" or schema is not None or options or not path_exists(spark, f"{path.rstrip('/')}/_delta_log"):
            raise
        return read_delta(spark, path)  # by its log, without the module


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    codec: str | None = None,
    partition_by: list[str] | None = None,
) -> str:
    """Write ``df`` as files and return the path."""
    if fmt not in BUILT_IN_FORMATS + EXTRA_FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.format(fmt).mode(mode)
    codec = codec or WRITE_CODEC.get(fmt)
    if codec:
        writer = writer.option("compression", codec)
    if fmt == "csv":
        writer = writer.options(**CSV_WRITE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _named_if_missing(fmt):
        writer.save(path)
    return path


def ensure_database(spark: SparkSession, name: str, location: str) -> str:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{location}'")
    return name


def save_table(
    df: DataFrame,
    table: str,
    mode: str = "overwrite",
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    bucket_by: tuple[int, list[str]] | None = None,
) -> str:
    """Save as a catalog table, bucketed if later joins should find the rows co-located."""
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        count, columns = bucket_by
        writer = writer.bucketBy(count, *columns).sortBy(*columns)
    writer.saveAsTable(table)
    return table


def scan_where(spark: SparkSession, table: str, predicate: str | Column) -> DataFrame:
    """Catalog read with a predicate; the scan takes over what its format can filter."""
    return spark.table(table).where(predicate)


def transform_sql(df: DataFrame, sql: str) -> DataFrame:
    """Run a query over ``df``, which the text names as ``{source_table}``.

    No view is registered by a fixed name, so jobs sharing a session cannot collide.
    """
    return df.sparkSession.sql(sql, source_table=df)


def scan_text_corpus(
    spark: SparkSession,
    path: str,
    pattern: str = "*.{sql,txt}",
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per text file below ``path``: (file_path, bytes, content, error).

    A file is one value; for files too large for that use ``scan_text_lines``. With
    ``max_bytes`` a larger file keeps its row, with an error in place of the content.
    Undecodable bytes and byte order marks are left out of the text.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    small = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    # a bad byte becomes U+FFFD, which is then left out together with the byte order mark
    text = F.regexp_replace(
        F.make_valid_utf8(F.col("content").cast("string")), "[\\uFFFD\\uFEFF]", ""
    )
    wanted = files.where(small).select(
        F.col("path").alias("file_path"),
        F.col("length").alias("bytes"),
        text.alias("content"),
        F.lit(None).cast("string").alias("error"),
    )
    too_large = files.where(~small).select(
        F.col("path").alias("file_path"),
        F.col("length").alias("bytes"),
        F.lit(None).cast("string").alias("content"),
        F.lit(f"file larger than {max_bytes} bytes").alias("error"),
    )
    return wanted.unionByName(too_large)


def scan_text_lines(spark: SparkSession, path: str, pattern: str = "*.{sql,txt}") -> DataFrame:
    """One row per line of the text files below ``path``: (file_path, split_start, line).

    Files of any size are read by splits; ``split_start`` is the byte a line's split begins at.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    )
    return lines.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.col("value").alias("line"),
    )


def write_by_source(
    df: DataFrame, path: str, source: str = "source", stamp: Column | None = None
) -> str:
    """One directory per source value, each row stamped with the run time."""
    if stamp is not None:
        df = df.withColumn("run_stamp", F.date_format(stamp, "yyyyMMdd_HHmmss"))
    # rows of one source are brought together, large sources in several tasks, so that the
    # number of files follows the bytes and not tasks times sources
    return write_table(df.hint("rebalance", F.col(source)), path, partition_by=[source])
