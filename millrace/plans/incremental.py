"""Incremental loads and streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import incremental as inc
from millrace.plans.registry import Tables, plan
from millrace.session import scratch_path
from millrace.streaming.bookmarks import run_bookmarked, stream_etl

EVENT = "event_id, user_id, event_type, value"
COLUMNS = EVENT.split(", ")
CUTS = ("2024-01-11", "2024-01-21", "2024-02-01")
SLICE = """CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 1 ELSE 2 END"""


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


@plan(
    "incr_lookback",
    f"SELECT {EVENT}, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= TIMESTAMP '2024-01-28 00:00:00'",
)
def incr_lookback(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "lookback")
    # the second run covers the first one's last two days again and leaves each row once
    for as_of in ("2024-01-30 06:00:00", "2024-01-31 00:00:00"):
        inc.load_lookback(t.events.where(F.col("ts") < _at(as_of)), path, "ts", _at(as_of), 48)
    back = t.spark.read.option("basePath", path).schema(
        "event_id bigint, user_id bigint, event_type string, value double, day string"
    ).parquet(path)
    return back.select(*COLUMNS, "day")


@plan("incr_watermark", f"SELECT {EVENT}, {SLICE} AS batch FROM events")
def incr_watermark(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "watermark")
    marks = inc.MarkStore(t.spark, f"{path}/marks")
    for cut in CUTS:  # the source as it was at three points in time
        inc.load_watermark(t.events.where(F.col("ts") < _at(cut)), path, "ts", "events", marks, ["event_id"])
    return t.spark.read.parquet(f"{path}/data").select(*COLUMNS, "batch")


@plan("incr_bookmark", f"SELECT {EVENT}, {SLICE} AS batch FROM events")
def incr_bookmark(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "bookmark")
    low = _at("1970-01-01")
    for cut in CUTS:  # new files arrive, then the job runs
        arrived = t.events.where((F.col("ts") >= low) & (F.col("ts") < _at(cut)))
        arrived.write.mode("append").parquet(f"{root}/in")
        low = _at(cut)
        run_bookmarked(t.spark, f"{root}/in", t.events.schema, f"{root}/out", root, "load-events")
    run_bookmarked(t.spark, f"{root}/in", t.events.schema, f"{root}/out", root, "load-events")
    return t.spark.read.parquet(f"{root}/out").select(*COLUMNS, "batch")


@plan(
    "stream_etl",
    "SELECT event_id, upper(event_type) AS kind, value * 2 AS doubled FROM events WHERE value > 5",
)
def stream_job(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "stream")
    stream_etl(
        t.spark,
        f"{t.folder}/events.parque[t]",  # a pattern may name one file as well as a folder
        t.events.schema,
        f"{root}/out",
        f"{root}/checkpoint",
        "SELECT event_id, upper(event_type) AS kind, value * 2 AS doubled FROM {source_table} WHERE value > 5",
    )
    return t.spark.read.parquet(f"{root}/out").select("event_id", "kind", "doubled")


@plan(
    "incr_metrics",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS run, COUNT(*) AS records,
           strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS first_event, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS last_event,
           date_diff('second', MIN(ts), MAX(ts)) AS window_seconds,
           date_diff('second', MAX(ts), TIMESTAMP '2024-01-31 00:00:00') AS freshness_seconds
    FROM events GROUP BY 1
    """,
)
def incr_metrics(t: Tables) -> DataFrame:
    runs = t.events.withColumn("run", F.date_format("ts", "yyyy-MM-dd"))
    return inc.run_metrics(runs, "run", "ts", _at("2024-01-31"))
