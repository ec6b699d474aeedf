"""Incremental loads by look-back window and by high-water mark."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from millrace.session import materialize, path_exists


class MarkStore:
    """High-water marks of all jobs: one appended row per update, the newest row wins.

    Appending keeps the marks of other jobs, and a lost update can be repeated.
    """

    SCHEMA = "job_name string, seq bigint, max_value string, updated_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def history(self) -> DataFrame:
        if path_exists(self.spark, self.path):
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return self.spark.createDataFrame([], self.SCHEMA)  # no mark was ever stored

    def _last(self, job: str):
        return (
            self.history()
            .where(F.col("job_name") == job)
            .agg(F.max("seq").alias("seq"), F.max_by("max_value", "seq").alias("value"))
            .first()
        )

    def get(self, job: str, default: str | None = None) -> str | None:
        value = self._last(job)["value"]
        return default if value is None else value

    def runs(self, job: str) -> int:
        """Number of updates stored for the job."""
        return self._last(job)["seq"] or 0

    def set(self, job: str, value: str) -> None:
        seq = self.runs(job) + 1
        row = self.spark.createDataFrame(
            [(job, seq, str(value))], "job_name string, seq bigint, max_value string"
        ).withColumn("updated_at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(self.path)


def lookback(df: DataFrame, column: str, as_of: Column, hours: int = 24, align: str | None = None) -> DataFrame:
    """Rows with ``column >= as_of - hours``; ``align`` moves the start down to a unit."""
    start = as_of - F.expr(f"INTERVAL {int(hours)} HOURS")
    if align:
        start = F.date_trunc(align, start).cast("timestamp_ntz")
    return df.where(F.col(column) >= start)


def load_lookback(
    df: DataFrame, path: str, column: str, as_of: Column, hours: int = 24
) -> None:
    """Reload the last ``hours`` into a folder partitioned by day.

    The window starts at a day boundary and whole days are replaced, so a rerun and late
    rows inside the window leave each row once.
    """
    recent = lookback(df, column, as_of, hours, align="day")
    (
        recent.withColumn("day", F.date_format(column, "yyyy-MM-dd"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def load_watermark(
    source: DataFrame,
    path: str,
    column: str,
    job: str,
    marks: MarkStore,
    key: list[str],
    transform: str | None = None,
    log: str | None = None,
) -> dict:
    """Load the rows above the mark of ``job`` into ``path/batch=n``, then move the mark.

    Rows equal to the mark are read again and dropped if an earlier batch has their key,
    so late rows that tie with the mark are not lost. The batch folder is overwritten, so a
    run that failed before the mark moved can be repeated. The new mark is observed while
    the data is written. Without a mark nothing is filtered. With ``log`` a row about the run is appended to that folder.
    """
    spark = source.sparkSession
    started = time.perf_counter()
    mark = marks.get(job)
    kind = source.schema[column].dataType
    rows = source if mark is None else source.where(F.col(column) >= F.lit(mark).cast(kind))
    batch = marks.runs(job)
    if batch:
        at_last = spark.read.parquet(f"{path}/ties/batch={batch - 1}")
        rows = rows.join(at_last, key, "left_anti")
    if transform:  # the keys at the new mark are taken from what was loaded, not read again
        rows = materialize(rows, "loaded")
    seen = Observation()
    observed = rows.observe(
        seen, F.max(column).cast("string").alias("newest"), F.count(F.lit(1)).alias("rows")
    )
    out = observed
    if transform:
        out = spark.sql(transform, source_table=observed)
    out.write.mode("overwrite").parquet(f"{path}/data/batch={batch}")
    metrics = dict(seen.get)
    if not metrics["rows"]:
        return {"rows": 0, "mark": mark, "batch": batch}
    newest = metrics["newest"]
    loaded = rows if transform else spark.read.schema(rows.schema).parquet(f"{path}/data/batch={batch}")
    at_mark = loaded.where(F.col(column) == F.lit(newest).cast(kind)).select(*key)
    if newest == mark and batch:
        at_mark = at_mark.unionByName(at_last)
    at_mark.write.mode("overwrite").parquet(f"{path}/ties/batch={batch}")
    marks.set(job, newest)
    if log:
        log_run(spark, log, job, batch, metrics["rows"], newest, time.perf_counter() - started)
    return {"rows": metrics["rows"], "mark": newest, "batch": batch}


RUN_LOG = "job_name string, batch int, records bigint, mark string, seconds double"


def log_run(spark: SparkSession, path: str, job: str, batch: int, records: int, mark: str, seconds: float) -> None:
    row = spark.createDataFrame([(job, batch, records, mark, seconds)], RUN_LOG)
    row.coalesce(1).write.mode("append").parquet(path)


def run_report(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """Per job of a run log: runs, records, mean latency, last mark and its age in seconds."""
    runs = spark.read.schema(RUN_LOG).parquet(path)
    last = F.max_by("mark", "batch")
    return runs.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("records").alias("records"),
        F.avg("seconds").alias("mean_seconds"),
        last.alias("mark"),
        F.timestamp_diff("SECOND", last.cast("timestamp_ntz"), as_of).alias("age_seconds"),
    )


def run_metrics(df: DataFrame, batch: str, column: str, as_of: Column) -> DataFrame:
    """Per run: records, first and last event, window length, freshness and running total."""
    first, last = F.min(column), F.max(column)
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("records"),
        F.date_format(first, "yyyy-MM-dd HH:mm:ss").alias("first_event"),
        F.date_format(last, "yyyy-MM-dd HH:mm:ss").alias("last_event"),
        F.timestamp_diff("SECOND", F.date_trunc("second", first), F.date_trunc("second", last)).alias("window_seconds"),
        F.timestamp_diff("SECOND", F.date_trunc("second", last), as_of).alias("freshness_seconds"),
    )
