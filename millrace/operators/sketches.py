"""Column statistics that can be merged: one row of sketches per file, kept beside the table.

``refresh`` reads only files it has not seen; ``merged`` adds up the rows of the files that are there
now, so statistics of a growing table never read old data again. Counts and extremes are exact. The
distinct count comes from a HyperLogLog sketch (standard error 1.04 / sqrt(2^LG_BINS), 1.6 %), quantiles
from a KLL sketch (rank error about 1.33 %). Their sizes do not depend on the rows.

A file is known by path, length and time of change: one that is written anew is read again, and rows
of files that are gone do not count. One writer at a time; a refresh that fails has added nothing.
Arrays, maps, structs and bytes have counts only. NaN is above all numbers in extremes and left out of quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, FractionalType, MapType, NumericType, StructType

from millrace.session import path_exists

LG_BINS = 12
QUARTILES = (0.25, 0.5, 0.75)


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _plain(kind: DataType) -> bool:
    return not isinstance(kind, (ArrayType, MapType, StructType, BinaryType))


def _hashed(column: Column, kind: DataType) -> Column:
    """Text the distinct count is taken of; the sketch passes over empty strings, so none is empty."""
    plain = column + F.lit(0.0) if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType) else column  # -0.0 is 0.0
    return F.concat(F.lit("="), plain.cast("string"))


def _sketch(column: Column, kind: DataType) -> Column:
    parts = [F.count(column).alias("n")]
    if _plain(kind):
        parts += [
            F.min(column).alias("low"),
            F.max(column).alias("high"),
            F.hll_sketch_agg(_hashed(column, kind), F.lit(LG_BINS)).alias("distinct"),
        ]
    if isinstance(kind, NumericType):
        value = column.cast("double")
        parts.append(F.kll_sketch_agg_double(F.when(~F.isnan(value), value)).alias("quantiles"))
    return F.struct(*parts)


def file_sketches(df: DataFrame) -> DataFrame:
    """(file, length, modified, n_rows, columns) of every file with rows behind ``df``, one sketch struct per column."""
    fields = df.schema.fields
    at = [F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time")]
    inner = df.select(F.struct(*at).alias("__at"), F.struct(*[_name(f.name) for f in fields]).alias("__row"))
    sketches = [_sketch(F.col("__row").getField(f.name), f.dataType).alias(f.name) for f in fields]
    return inner.groupBy("__at").agg(F.count(F.lit(1)).alias("n_rows"), F.struct(*sketches).alias("columns")).select(
        F.col("__at.file_path").alias("file"), F.col("__at.file_size").alias("length"),
        F.col("__at.file_modification_time").alias("modified"), "n_rows", "columns",
    )


def _present(spark: SparkSession, source: str) -> DataFrame:
    """Files of a folder: ``p`` as their rows name them (encoded), ``path`` as a reader takes it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(source)
    return files.select("path", F.col("_metadata.file_path").alias("p"), F.col("length").alias("l"), F.col("modificationTime").alias("m"))


def _same(files: DataFrame, stored: DataFrame) -> Column:
    return (files["p"] == stored["file"]) & (files["l"] == stored["length"]) & (files["m"] == stored["modified"])


def refresh(spark: SparkSession, source: str, store: str) -> int:
    """Sketch the files of a Parquet folder that ``store`` does not know; how many there were.

    Only their paths come to the driver, as with any scan. A file without rows has no sketch, costs its
    footer again at the next refresh, and changes nothing.
    """
    files = _present(spark, source)
    if path_exists(spark, store):
        stored = spark.read.parquet(store).select("file", "length", "modified")
        files = files.join(stored, _same(files, stored), "left_anti")
    paths = [r.path for r in files.select("path").collect()]
    if paths:
        schema = spark.read.parquet(source).schema  # partition values have one type over all files
        file_sketches(spark.read.schema(schema).option("basePath", source).parquet(*paths)).write.mode("append").parquet(store)
    return len(paths)


def merged(spark: SparkSession, source: str, store: str) -> DataFrame:
    """(column_name, n_rows, n_nulls, low, high, n_distinct, quartiles) over the files that are there now.

    One row per column; low and high as text, quartiles only of numbers. A table without rows has zeros
    and nulls; one that was never refreshed is an error.
    """
    stored = spark.read.option("mergeSchema", True).parquet(store)
    files = _present(spark, source)
    live = stored.join(files, _same(files, stored), "left_semi")

    def total(name: str, kind: StructType) -> Column:
        part = lambda field: F.col("columns").getField(name).getField(field)
        has = set(kind.fieldNames())
        none = lambda t: F.lit(None).cast(t)
        count = F.coalesce(F.sum(part("n")), F.lit(0))
        quartiles = F.array(*[F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(part("quantiles")), F.lit(q)) for q in QUARTILES]) if "quantiles" in has else none("array<double>")
        return F.struct(
            F.lit(name).alias("column_name"),
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
            (F.coalesce(F.sum("n_rows"), F.lit(0)) - count).alias("n_nulls"),
            (F.min(part("low")).cast("string") if "low" in has else none("string")).alias("low"),
            (F.max(part("high")).cast("string") if "low" in has else none("string")).alias("high"),
            (F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(part("distinct"))), F.lit(0)) if "low" in has else none("bigint")).alias("n_distinct"),
            F.when(count > 0, quartiles).alias("quartiles"),
        )

    kinds = stored.schema["columns"].dataType
    rows = live.agg(F.array(*[total(f.name, f.dataType) for f in kinds.fields]).alias("rows"))
    return rows.select(F.explode("rows").alias("r")).select("r.*")
