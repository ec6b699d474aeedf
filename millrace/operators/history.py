"""Run history: stored results, key-value context, expiry, batch summaries, trends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.aggregates import top_k
from millrace.operators.windows import Order, latest_per_key, top_per_group
from millrace.session import spread


def mean(column: str | Column) -> Column:
    """Average of a two-decimal amount from its exact sum."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast("decimal(18,2)")).cast("double") / F.count(column)


# --- stored results ----------------------------------------------------------------


def statement_key(text: str | Column) -> Column:
    """Key of a statement: md5 of its lower-case text without white space at either end."""
    text = F.col(text) if isinstance(text, str) else text
    return F.md5(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")))


def store_results(history: DataFrame, batch: DataFrame, text: str, order: Order) -> DataFrame:
    """History after a batch: a stored statement is replaced, a new one added.

    Both inputs have the same columns; ``order`` lists newest first and puts the batch
    before the history.
    """
    both = history.unionByName(batch).withColumn("statement_key", statement_key(text))
    return latest_per_key(both, ["statement_key"], order)


def look_up(batch: DataFrame, history: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Each statement of a batch with its stored result, and whether there was one."""
    keyed = batch.withColumn("statement_key", statement_key(text))
    stored = history.select("statement_key", *columns, F.lit(True).alias("__hit"))
    joined = keyed.join(stored, "statement_key", "left")
    return joined.withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def recent(df: DataFrame, order: Order, limit: int) -> DataFrame:
    return top_k(df, order, limit)


def search(df: DataFrame, columns: list[str], text: str, order: Order, limit: int) -> DataFrame:
    """Rows where any column contains the text, ASCII case ignored; newest first."""
    wanted = None
    for c in columns:
        hit = F.col(c).ilike(f"%{text}%")
        wanted = hit if wanted is None else wanted | hit
    return top_k(df.where(wanted), order, limit)


def latest_values(df: DataFrame, key: str, value: str, at: Column) -> DataFrame:
    """The newest JSON value per key, and the same parsed where it is valid JSON."""
    newest = df.groupBy(key).agg(F.max_by(value, at).alias("value"))
    return newest.withColumn("parsed", F.try_parse_json("value"))


# --- metrics -----------------------------------------------------------------------


def effectiveness(df: DataFrame, label: str, value: str, pattern: str) -> DataFrame:
    """Mean, minimum, maximum and count where the label contains the pattern; zeros if none."""
    hit = df.where(F.col(label).ilike(f"%{pattern}%"))
    zero = F.lit(0.0)
    return hit.agg(
        F.coalesce(F.try_divide(F.sum(F.col(value).cast("decimal(18,2)")).cast("double"), F.count(value)), zero).alias("mean"),
        F.coalesce(F.min(value), zero).alias("low"),
        F.coalesce(F.max(value), zero).alias("high"),
        F.count(F.lit(1)).alias("n"),
    )


# --- expiry ------------------------------------------------------------------------


def live(df: DataFrame, expires: str, as_of: Column) -> DataFrame:
    """Rows that have not expired; rewriting a table with them purges the others."""
    return df.where(F.col(expires) > as_of)


def expiry_statistics(df: DataFrame, kind: str, expires: str, as_of: Column) -> DataFrame:
    active = F.count(F.when(F.col(expires) > as_of, 1))
    total = F.count(F.lit(1))
    return df.groupBy(kind).agg(
        total.alias("total"), active.alias("active"), (total - active).alias("expired")
    )


# --- batches -----------------------------------------------------------------------


def batch_summary(results: DataFrame, job: str, parts: DataFrame, unit: str) -> DataFrame:
    """Per job: files and queries that succeeded or failed, their rates, and the status.

    ``results`` has (job, unit, ok) per file; ``parts`` has (unit, n_ok, n_failed) query
    counts per file. A job has failed only if no file of it succeeded.
    """
    joined = results.join(parts, unit, "left")
    per_job = joined.groupBy(job).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count(F.when(F.col("ok"), 1)).alias("ok_files"),
        F.count(F.when(~F.col("ok"), 1)).alias("failed_files"),
        F.coalesce(F.sum("n_ok"), F.lit(0)).alias("ok_queries"),
        F.coalesce(F.sum("n_failed"), F.lit(0)).alias("failed_queries"),
    )
    queries = F.col("ok_queries") + F.col("failed_queries")
    return per_job.select(
        "*",
        (F.col("ok_files") / F.col("total_files") * 100).alias("file_rate"),
        F.coalesce(F.try_divide(F.col("ok_queries"), queries) * 100, F.lit(0.0)).alias("query_rate"),
        F.when((F.col("failed_files") > 0) & (F.col("ok_files") == 0), "failed").otherwise("completed").alias("status"),
    )


def label_counts(df: DataFrame, labels: Column) -> DataFrame:
    """How often each label occurs, most frequent first."""
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.orderBy(F.desc("n"), "label")


def run_each(df: DataFrame, key: str, column: str, fn: Callable[[str], object]) -> DataFrame:
    """(key, result, error) of ``fn`` for each row; a row that fails gives an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], []
            for value in batch[column]:
                try:
                    results.append(str(fn(value)))
                    errors.append(None)
                except Exception as err:  # the row's error is its result
                    results.append(None)
                    errors.append(type(err).__name__)
            yield pd.DataFrame({key: batch[key], "result": results, "error": errors})

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, column)).mapInPandas(run, f"{key} {kind}, result string, error string")


# --- timings -----------------------------------------------------------------------
# Timings have (name, duration, run_at, passed, parallel, cached).


def _since(as_of: Column, days: int) -> Column:
    return F.col("run_at") > as_of - F.expr(f"INTERVAL {days} DAYS")


def slowest(timings: DataFrame, as_of: Column, limit: int = 10, days: int = 7) -> DataFrame:
    """The slowest names of the last days, passed runs only."""
    stats = timings.where(_since(as_of, days) & F.col("passed")).groupBy("name").agg(
        mean("duration").alias("avg_duration"),
        F.max("duration").alias("max_duration"),
        F.min("duration").alias("min_duration"),
        F.count(F.lit(1)).alias("n_runs"),
    )
    return top_k(stats, [("avg_duration", False), ("name", True)], limit)


def _flag_rates() -> list[Column]:
    total = F.count(F.lit(1))
    return [
        F.count(F.when(F.col("parallel"), 1)).alias("n_parallel"),
        F.count(F.when(F.col("cached"), 1)).alias("n_cached"),
        (F.count(F.when(F.col("parallel"), 1)) / total).alias("parallel_rate"),
        (F.count(F.when(F.col("cached"), 1)) / total).alias("cached_rate"),
    ]


def daily_trend(timings: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Per day of the last days: mean duration, runs, and how many were parallel or cached."""
    return (
        timings.where(_since(as_of, days))
        .groupBy(F.date_format("run_at", "yyyy-MM-dd").alias("day"))
        .agg(mean("duration").alias("avg_duration"), F.count(F.lit(1)).alias("n_runs"), *_flag_rates())
        .orderBy(F.desc("day"))
        .limit(days)
    )


def name_history(timings: DataFrame, name, as_of: Column, days: int = 30) -> DataFrame:
    return timings.where(_since(as_of, days) & (F.col("name") == name)).orderBy(F.desc("run_at"))


def regressions(timings: DataFrame, as_of: Column, threshold: float = 1.5) -> DataFrame:
    """Names whose mean of the last 7 days exceeds that of the 23 days before by a factor.

    Both means come from one pass: the period is a condition inside the aggregates.
    """
    new = _since(as_of, 7)
    old = (F.col("run_at") >= as_of - F.expr("INTERVAL 30 DAYS")) & (
        F.col("run_at") <= as_of - F.expr("INTERVAL 7 DAYS")
    )
    stats = timings.where(F.col("passed") & (new | old)).groupBy("name").agg(
        mean(F.when(new, F.col("duration"))).alias("recent_avg"),
        mean(F.when(old, F.col("duration"))).alias("previous_avg"),
    )
    ratio = F.try_divide("recent_avg", "previous_avg")
    return (
        stats.withColumn("ratio", ratio)
        .where(F.col("ratio") > threshold)
        .withColumn("slowdown_percent", (F.col("ratio") - 1) * 100)
        .orderBy(F.desc("ratio"), "name")
    )


def summary_report(timings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return timings.where(_since(as_of, days)).agg(
        F.count(F.lit(1)).alias("n_runs"),
        mean("duration").alias("avg_duration"),
        F.max("duration").alias("max_duration"),
        *_flag_rates(),
    )


def flaky_names(
    results: DataFrame, name: str, failed: str, order: Order, threshold: float = 0.3
) -> DataFrame:
    """Names that fail sometimes: failure rate of the last 10 runs above 0 and below
    1 - threshold, with at least 3 runs; ``order`` lists newest first.

    Only ten runs per name survive the shuffle, so the list of the last five is bounded.
    """
    last = top_per_group(results, [name], order, 10, "__rn")
    state = F.struct(F.col("__rn"), F.when(F.col(failed), "failed").otherwise("passed").alias("state"))
    runs = last.groupBy(name).agg(
        F.count(F.lit(1)).alias("n_runs"),
        (F.count(F.when(F.col(failed), 1)) / F.count(F.lit(1))).alias("failure_rate"),
        F.sort_array(F.collect_list(F.when(F.col("__rn") <= 5, state)), False).alias("__last"),
    )
    flaky = (F.col("n_runs") >= 3) & (F.col("failure_rate") > 0) & (F.col("failure_rate") < 1 - threshold)
    return runs.where(flaky).select(
        name,
        "n_runs",
        "failure_rate",
        F.array_join(F.transform("__last", lambda s: s["state"]), ",").alias("last_results"),
    )

