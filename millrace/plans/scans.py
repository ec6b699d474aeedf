"""Scans and sinks: every format, catalog tables, corpora, whole jobs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.operators.etl import combine_sources, run_etl
from millrace.plans.registry import Tables, plan
from millrace.session import scratch_path
from millrace.sources import delta_log, files

CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


@plan(
    "flagship_top_customers",
    """
    SELECT c_custkey, c_name, n_name,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
           COUNT(*) AS n_lines
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    WHERE l_shipdate > TIMESTAMP '1995-06-30 00:00:00' AND o_orderstatus <> 'F'
    GROUP BY c_custkey, c_name, n_name
    ORDER BY revenue DESC, c_custkey
    LIMIT 10
    """,
)
def flagship(t: Tables) -> DataFrame:
    # Lines are summed per order before they meet the orders, so an order or customer
    # with very many lines reaches the joins as few rows.
    per_order = (
        t.lineitem.where(F.col("l_shipdate") > F.lit("1995-06-30").cast("timestamp_ntz"))
        .groupBy("l_orderkey")
        .agg(
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    per_customer = (
        t.orders.where(F.col("o_orderstatus") != "F")
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("amount").alias("amount"), F.sum("lines").alias("n_lines"))
    )
    return (
        per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey", "c_name", "n_name", F.col("amount").cast("double").alias("revenue"), "n_lines"
        )
        .orderBy(F.desc("revenue"), "c_custkey")
        .limit(10)
    )


@plan("scan_parquet", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def scan_parquet(t: Tables) -> DataFrame:
    df = files.read_table(t.spark, t.path("orders"))
    return df.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


def _round_trip(t: Tables, table: str, fmt: str, **options) -> DataFrame:
    df = getattr(t, table)
    path = files.write_table(df, scratch_path(t.spark, f"{table}-{fmt}"), fmt)
    return files.read_table(t.spark, path, fmt, schema=df.schema, **options)


@plan("scan_csv", f"SELECT {CUSTOMER} FROM customer")
def scan_csv(t: Tables) -> DataFrame:
    return _round_trip(t, "customer", "csv")


@plan("scan_json", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_json(t: Tables) -> DataFrame:
    return _round_trip(t, "supplier", "json")


@plan("scan_orc", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def scan_orc(t: Tables) -> DataFrame:
    return _round_trip(t, "part", "orc")


KEPT = "l_returnflag IN ('A', 'N') OR l_quantity > 25"


@plan(
    "scan_delta",
    f"SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE {KEPT}",
)
def scan_delta(t: Tables) -> DataFrame:
    """A table with a log: partitioned files are added, a checkpoint is made, files are removed and others added."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    table = scratch_path(t.spark, "lineitem-log")

    def add(df: DataFrame, name: str) -> list[dict]:
        df.write.partitionBy("l_returnflag").parquet(f"{table}/{name}")
        found = t.spark.read.schema("l_orderkey bigint").option("recursiveFileLookup", True).parquet(f"{table}/{name}")
        paths = [r[0] for r in found.select(F.col("_metadata.file_path")).distinct().collect()]
        below = [p[p.index(f"/{name}/") + 1 :] for p in sorted(paths)]
        return [{"add": {"path": p, "partitionValues": {"l_returnflag": p.split("l_returnflag=")[1][:1]}, "size": 1}} for p in below]

    first = add(rows, "one")
    head = [{"protocol": {"minReaderVersion": 1}}, delta_log.metadata_of(rows.schema, ["l_returnflag"])]
    delta_log.write_commit(t.spark, table, 0, head + first)
    returned = [e["add"]["path"] for e in first if e["add"]["partitionValues"]["l_returnflag"] == "R"]
    half = [{"remove": {"path": p}} for p in returned]
    delta_log.write_commit(t.spark, table, 1, half)
    delta_log.write_checkpoint(t.spark, table, 1)
    again = add(rows.where("l_returnflag = 'R' AND l_quantity > 25"), "two")
    delta_log.write_commit(t.spark, table, 2, again)
    return delta_log.read_delta(t.spark, table)


def _fresh_database(t: Tables) -> str:
    name = f"millrace_{uuid.uuid4().hex[:12]}"
    return files.ensure_database(t.spark, name, scratch_path(t.spark, "db"))


@plan("scan_catalog", f"SELECT {CUSTOMER} FROM customer")
def scan_catalog(t: Tables) -> DataFrame:
    db = _fresh_database(t)
    files.save_table(t.customer, f"{db}.customer")
    return t.spark.table(f"{db}.customer")


@plan(
    "scan_pushdown",
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
      AND l_quantity > 10
    """,
)
def scan_pushdown(t: Tables) -> DataFrame:
    # the files are registered where they lie; only the filtered row groups are read
    db = _fresh_database(t)
    t.spark.sql(f"CREATE TABLE {db}.lineitem USING parquet LOCATION '{t.path('lineitem')}'")
    wanted = (
        "l_shipdate >= TIMESTAMP_NTZ '1997-01-01' AND l_shipdate < TIMESTAMP_NTZ '1998-01-01'"
        " AND l_quantity > 10"
    )
    found = files.scan_where(t.spark, f"{db}.lineitem", wanted)
    return found.select("l_orderkey", "l_linenumber", "l_quantity")


@plan(
    "sql_over_view",
    """
    SELECT o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS top_price
    FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority
    """,
)
def sql_over_view(t: Tables) -> DataFrame:
    return files.transform_sql(
        t.orders,
        "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top_price "
        "FROM {source_table} WHERE o_orderstatus = 'O' GROUP BY o_orderpriority",
    )


@plan(
    "write_format",
    """
    SELECT fmt, COUNT(*) AS n, MIN(c_custkey) AS low, MAX(c_custkey) AS high,
           CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
    FROM customer, (VALUES ('parquet'), ('orc'), ('csv'), ('json')) AS f(fmt) GROUP BY fmt
    """,
)
def write_format(t: Tables) -> DataFrame:
    parts = []
    for fmt in files.BUILT_IN_FORMATS:
        path = scratch_path(t.spark, f"customer-{fmt}")
        files.write_table(t.customer, path, fmt)
        files.write_table(t.customer.limit(0), path, fmt, mode="append")
        back = files.read_table(t.spark, path, fmt, schema=t.customer.schema)
        parts.append(back.withColumn("fmt", F.lit(fmt)))
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("fmt")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("c_custkey").alias("low"),
            F.max("c_custkey").alias("high"),
            F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"),
        )
    )


@plan("write_partitioned", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def write_partitioned(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "orders-by-status")
    files.write_table(t.orders, path, partition_by=["o_orderstatus"])
    back = files.read_table(t.spark, path)
    return back.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@plan(
    "write_table",
    f"SELECT {CUSTOMER} FROM customer UNION ALL "
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier",
)
def write_table(t: Tables) -> DataFrame:
    db = _fresh_database(t)
    table = files.save_table(t.customer, f"{db}.parties")
    more = t.supplier.select(
        F.col("s_suppkey").alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"),
    )
    files.save_table(more, table, mode="append")
    return t.spark.table(table)


@plan(
    "scan_text_corpus",
    """
    SELECT CAST(SUM(length(text)) + COUNT(*) AS BIGINT) AS n_chars,
           CAST(SUM(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines,
           0 AS n_errors
    FROM documents
    """,
)
def scan_text_corpus(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "corpus")
    t.documents.select("text").write.text(path)
    lines = files.scan_text_lines(t.spark, path)
    # every file ends with a line break, so there are as many breaks as lines
    by_line = lines.agg(
        F.sum(F.length("line") + 1).cast("bigint").alias("n_chars"),
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
    )
    errors = files.scan_text_corpus(t.spark, path).agg(F.count("error").cast("int").alias("n_errors"))
    return by_line.withColumn("n_errors", errors.scalar())


@plan(
    "write_by_source",
    "SELECT doc_id, n_chars, source, '20240131_000000' AS run_stamp FROM documents",
)
def write_by_source(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "by-source")
    stamp = F.lit("2024-01-31").cast("timestamp_ntz")
    files.write_by_source(t.documents, path, stamp=stamp)
    back = files.read_table(t.spark, path)
    return back.select("doc_id", "n_chars", "source", "run_stamp")


@plan(
    "etl_job",
    """
    SELECT l_orderkey, l_linenumber, l_returnflag,
           CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net,
           COUNT(*) OVER () AS rows_written
    FROM lineitem WHERE l_quantity >= 10
    """,
)
def etl_job(t: Tables) -> DataFrame:
    done = run_etl(
        t.spark,
        t.path("lineitem"),
        scratch_path(t.spark, "etl"),
        "SELECT l_orderkey, l_linenumber, l_returnflag, "
        "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS net "
        "FROM {source_table} WHERE l_quantity >= 10",
        target_format="orc",
    )
    back = files.read_table(t.spark, done.path, done.fmt)
    return back.withColumn("rows_written", F.lit(done.metrics["rows_written"]).cast("bigint"))


@plan(
    "multi_source_job",
    """
    SELECT custkey, name, segment, last_order, n_orders,
           '2024-01-31 00:00:00' AS processed_timestamp
    FROM (SELECT c_custkey AS custkey, c_name AS name, c_mktsegment AS segment,
                 MAX(o_orderkey) AS last_order, COUNT(*) AS n_orders
          FROM customer JOIN orders ON c_custkey = o_custkey
          WHERE c_acctbal > 0 GROUP BY 1, 2, 3)
    """,
)
def multi_source_job(t: Tables) -> DataFrame:
    customers = t.customer.select(
        F.col("c_custkey").alias("custkey"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )
    orders = t.orders.select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("last_order")
    )
    counts = orders.groupBy("custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    out = combine_sources(
        [orders, customers, counts],
        ["custkey"],
        where=F.col("balance") > 0,
        columns=["custkey", "name", "segment", "last_order", "n_orders"],
        stamp=F.lit("2024-01-31 00:00:00"),
        dedupe_on=["custkey"],
        dedupe_order=[("last_order", False)],
    )
    path = files.write_table(out, scratch_path(t.spark, "combined"))
    return files.read_table(t.spark, path)
