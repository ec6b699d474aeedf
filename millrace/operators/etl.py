"""Whole jobs made of the other operators: read, transform, write, measure."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from millrace.operators.hotkeys import spread_join
from millrace.operators.joins import outer_join
from millrace.operators.windows import latest_per_key
from millrace.sources.files import read_table, transform_sql, write_table


@dataclass
class EtlResult:
    path: str
    fmt: str
    metrics: dict = field(default_factory=dict)


def run_etl(
    spark: SparkSession,
    source: str,
    target: str,
    transform: str | None = None,
    source_format: str = "parquet",
    target_format: str = "parquet",
    mode: str = "errorifexists",
    partition_by: list[str] | None = None,
) -> EtlResult:
    """Read, apply SQL over ``{source_table}``, write, and report rows written.

    The row count is observed while the data is written, not by a second pass.
    """
    df = read_table(spark, source, source_format)
    if transform:
        df = transform_sql(df, transform)
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows_written"))
    write_table(df, target, target_format, mode, partition_by=partition_by)
    return EtlResult(target, target_format, dict(seen.get))


def combine_sources(
    sources: list[DataFrame],
    keys: list[str],
    where: Column | None = None,
    columns: list[str] | None = None,
    stamp: Column | None = None,
    dedupe_on: list[str] | None = None,
    dedupe_order: list[tuple[str, bool]] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join N sources on shared keys, filter, project, stamp and drop repeated rows.

    ``how`` is inner, left, right or full; the keys of an outer join are those of either side. Rows of hot
    keys are dealt over many tasks.
    """
    out = sources[0]
    for other in sources[1:]:
        renamed = other.withColumnsRenamed({k: f"__r_{k}" for k in keys})
        pairs = [(k, f"__r_{k}") for k in keys]
        joined = spread_join(out, renamed, pairs) if how == "inner" else outer_join(out, renamed, pairs, how)
        named = [F.coalesce(k, f"__r_{k}").alias(k) for k in keys]
        out = joined.select(*named, *[c for c in joined.columns if c not in keys and not c.startswith("__r_")])
    if where is not None:
        out = out.where(where)
    if columns:
        out = out.select(*columns)
    if dedupe_on:
        out = latest_per_key(out, dedupe_on, dedupe_order or [(c, True) for c in out.columns])
    if stamp is not None:
        out = out.withColumn("processed_timestamp", stamp)
    return out
