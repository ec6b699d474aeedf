"""Change data capture over customers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from millrace.operators import cdc
from millrace.operators.file_table import FileTable, apply_changes, stream_into
from millrace.operators.incremental import MarkStore
from millrace.plans.derived import CUSTOMER_CHANGES, customer_changes
from millrace.plans.registry import Tables, plan
from millrace.session import scratch_path
from millrace.sources.files import ensure_database

COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
NEWEST_FIRST = [("seq", False), ("tie", False)]
LATEST = f"""
    changes AS ({CUSTOMER_CHANGES}),
    last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY seq DESC, tie DESC) AS rn
                            FROM changes) WHERE rn = 1)
"""
OLD = "TIMESTAMP '1970-01-01 00:00:00'"


def _job_target(t: Tables) -> tuple[str, MarkStore]:
    root = scratch_path(t.spark, "cdc-job")
    db = ensure_database(t.spark, f"millrace_{uuid.uuid4().hex[:12]}", f"{root}/db")
    return f"{db}.customer", MarkStore(t.spark, f"{root}/marks")


def _files(t: Tables, strategy: str) -> DataFrame:
    """Load the first changes, then the rest, into a table of files that has no state at first."""
    changes = customer_changes(t)
    table = FileTable(t.spark, scratch_path(t.spark, "customer-files"), changes.schema, ["c_custkey"])
    for cut in ("1998-01-01", "2010-01-01"):
        arrived = changes.where(F.col("seq") < F.lit(cut).cast("timestamp_ntz"))
        apply_changes(table, arrived, "seq", [("tie", False)], strategy)
    apply_changes(table, changes, "seq", [("tie", False)], strategy)
    return table.read().select(*COLUMNS.split(", "), "tie")


def _run(t: Tables, strategy: str) -> DataFrame:
    """Load the first changes, then the rest, into a catalog table that does not exist at first."""
    table, marks = _job_target(t)
    changes = customer_changes(t)
    for cut in ("1998-01-01", "2010-01-01"):
        arrived = changes.where(F.col("seq") < F.lit(cut).cast("timestamp_ntz"))
        cdc.run_cdc(t.spark, arrived, table, "seq", ["c_custkey"], marks, strategy, [("tie", False)])
    cdc.run_cdc(t.spark, changes, table, "seq", ["c_custkey"], marks, strategy, [("tie", False)])
    return t.spark.table(table).select(*COLUMNS.split(", "), "tie")


@plan("cdc_upsert", f"WITH {LATEST} SELECT {COLUMNS}, tie FROM last")
def cdc_upsert(t: Tables) -> DataFrame:
    return _files(t, "upsert")


@plan("cdc_catalog_upsert", f"WITH {LATEST} SELECT {COLUMNS}, tie FROM last")
def cdc_catalog_upsert(t: Tables) -> DataFrame:
    return _run(t, "upsert")


@plan("cdc_stream", f"WITH {LATEST} SELECT {COLUMNS}, tie FROM last")
def cdc_stream(t: Tables) -> DataFrame:
    """The changes arrive as a stream of files and are merged batch by batch; the job is started twice."""
    changes = customer_changes(t)
    root = scratch_path(t.spark, "cdc-stream")
    table = FileTable(t.spark, f"{root}/table", changes.schema, ["c_custkey"])
    table.create(changes.limit(0))
    early = F.col("seq") < F.lit("1998-01-01").cast("timestamp_ntz")
    for part in (changes.where(early), changes.where(~early)):
        part.repartition(4, "c_custkey").write.mode("append").parquet(f"{root}/arrivals")
        arriving = t.spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/arrivals")
        stream_into(table, arriving, "customer_changes", NEWEST_FIRST, f"{root}/offsets").awaitTermination()
    return table.read().select(*COLUMNS.split(", "), "tie")


@plan("cdc_append", f"SELECT {COLUMNS}, tie FROM ({CUSTOMER_CHANGES})")
def cdc_append(t: Tables) -> DataFrame:
    return _run(t, "append")


@plan(
    "cdc_merge_dedup",
    f"""
    WITH changes AS ({CUSTOMER_CHANGES}),
    marked AS (SELECT *, seq < TIMESTAMP '1998-01-01 00:00:00' AS early FROM changes),
    kept AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY early DESC, seq DESC, tie DESC) AS rn FROM marked)
    SELECT {COLUMNS}, tie FROM kept WHERE rn = 1
    """,
)
def cdc_merge_dedup(t: Tables) -> DataFrame:
    return _files(t, "merge")


@plan(
    "cdc_new_mark",
    f"SELECT strftime(MAX(seq), '%Y-%m-%d %H:%M:%S') AS mark, 1 AS updates FROM ({CUSTOMER_CHANGES})",
)
def cdc_new_mark(t: Tables) -> DataFrame:
    table, marks = _job_target(t)
    changes = customer_changes(t)
    for _ in range(2):  # the second run finds nothing new and leaves the mark alone
        cdc.run_cdc(t.spark, changes, table, "seq", ["c_custkey"], marks, "upsert", [("tie", False)])
    return marks.history().groupBy("job_name").agg(
        F.max("max_value").alias("mark"), F.count(F.lit(1)).cast("int").alias("updates")
    ).drop("job_name")


@plan(
    "cdc_partition_upsert",
    f"""
    WITH {LATEST}
    SELECT {COLUMNS} FROM last
    UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM last)
    """,
)
def cdc_partition_upsert(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "by-segment")
    t.customer.write.partitionBy("c_mktsegment").parquet(path)
    cdc.upsert_partitions(
        t.spark, path, customer_changes(t), ["c_custkey"], NEWEST_FIRST, ["c_mktsegment"]
    )
    return t.spark.read.schema(t.customer.schema).parquet(path).select(*COLUMNS.split(", "))


@plan(
    "cdc_metrics",
    f"""
    WITH changes AS ({CUSTOMER_CHANGES}),
    per_key AS (SELECT c_custkey AS k, COUNT(*) AS n FROM changes GROUP BY 1)
    SELECT COUNT(*) FILTER (c_custkey IS NULL) AS inserted, COUNT(*) FILTER (c_custkey IS NOT NULL AND k IS NOT NULL) AS updated,
           COUNT(*) FILTER (k IS NULL) AS unchanged, COUNT(*) FILTER (n > 1) AS conflicts,
           (SELECT date_diff('second', MAX(seq), TIMESTAMP '2003-01-01 00:00:00') FROM changes) AS freshness_seconds
    FROM customer FULL JOIN per_key ON c_custkey = k
    """,
)
def cdc_metrics(t: Tables) -> DataFrame:
    as_of = F.lit("2003-01-01").cast("timestamp_ntz")
    return cdc.change_metrics(t.customer, customer_changes(t), ["c_custkey"], NEWEST_FIRST, "seq", as_of)
