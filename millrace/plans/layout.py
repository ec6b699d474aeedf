"""File layout and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.operators import layout as ly, sketches as sk
from millrace.plans.derived import FILE_PATHS, file_paths, from_sql
from millrace.plans.registry import Tables, plan
from millrace.plans.schema import TABLES, columns_of
from millrace.session import scratch_path
from millrace.sources.files import read_table, write_table

ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
FILES = f"SELECT path, length, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM ({FILE_PATHS})"


@plan("file_inventory")
def file_inventory(t: Tables) -> DataFrame:
    files = ly.file_inventory(t.spark, t.folder, "*.parquet")
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", ly.format_of("path").alias("format")
    )


@plan(
    "partition_discovery",
    f"""
    SELECT key, COUNT(DISTINCT value) AS n_values, CAST(COUNT(*) AS BIGINT) AS n_files FROM (
      SELECT unnest(regexp_extract_all(path, '([A-Za-z_][A-Za-z0-9_]*)=([^/]+)', 1)) AS key,
             unnest(regexp_extract_all(path, '([A-Za-z_][A-Za-z0-9_]*)=([^/]+)', 2)) AS value FROM ({FILE_PATHS})) GROUP BY key
    """,
)
def partition_discovery(t: Tables) -> DataFrame:
    return ly.partition_keys(file_paths(t))


@plan(
    "format_from_path",
    f"""
    SELECT path, CASE WHEN contains(lower(path), '.parquet') THEN 'parquet' WHEN contains(lower(path), '.csv') THEN 'csv'
           ELSE 'unknown' END AS format FROM ({FILE_PATHS})
    """,
)
def format_from_path(t: Tables) -> DataFrame:
    return file_paths(t).select("path", ly.format_of("path").alias("format"))


@plan(
    "small_file_report",
    f"""
    SELECT folder, COUNT(*) AS n_files, CAST(SUM(length) AS BIGINT) AS bytes,
           CAST(SUM(length) AS DOUBLE) / COUNT(*) AS mean_bytes, COUNT(*) FILTER (length < 134217728) AS n_small,
           CAST(CEIL(CAST(SUM(length) AS DOUBLE) / 134217728) AS BIGINT) AS n_wanted, COUNT(*) > 1000 AS too_many
    FROM ({FILES}) GROUP BY folder
    """,
)
def small_file_report(t: Tables) -> DataFrame:
    return ly.small_file_report(file_paths(t))


def _scattered(t: Tables) -> str:
    """Orders as many small files."""
    path = scratch_path(t.spark, "scattered")
    return write_table(t.orders.drop("o_orderdate").repartition(40), path)


@plan("compact_coalesce", f"SELECT {ORDER} FROM orders")
def compact_coalesce(t: Tables) -> DataFrame:
    target = scratch_path(t.spark, "coalesced")
    ly.compact(t.spark, _scattered(t), target)
    return read_table(t.spark, target).select(*ORDER.split(", "))


@plan("compact_repartition", f"SELECT {ORDER} FROM orders")
def compact_repartition(t: Tables) -> DataFrame:
    target = scratch_path(t.spark, "rebalanced")
    ly.compact(t.spark, _scattered(t), target, "repartition", partition_by=["o_orderstatus"])
    return read_table(t.spark, target).select(*ORDER.split(", "))


@plan(
    "convert_format",
    """
    SELECT codec, s_suppkey, s_name, s_nationkey, s_acctbal
    FROM supplier, (VALUES ('snappy'), ('gzip'), ('lz4'), ('zstd')) AS c(codec)
    """,
)
def convert_format(t: Tables) -> DataFrame:
    source = write_table(t.supplier, scratch_path(t.spark, "supplier-csv"), "csv")
    parts = []
    for codec in ("snappy", "gzip", "lz4", "zstd"):
        target = scratch_path(t.spark, f"supplier-{codec}")
        name = {"lz4": "lz4_raw"}.get(codec, codec)
        ly.convert_format(t.spark, source, "csv", target, codec=name, schema=t.supplier.schema)
        parts.append(read_table(t.spark, target).withColumn("codec", F.lit(codec)))
    return reduce(DataFrame.unionByName, parts)


# Descriptions of many tables, one per order.
TABLE_META = """
    SELECT concat('t', CAST(o_orderkey AS VARCHAR(20))) AS table_name,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'csv' WHEN '2-HIGH' THEN 'json' WHEN '3-MEDIUM' THEN 'parquet'
                                WHEN '4-NOT SPECIFIED' THEN 'orc' ELSE 'delta' END AS format,
           o_totalprice / 2500 AS size_gb, CAST(extract(month FROM o_orderdate) AS INT) % 6 AS partition_levels,
           o_orderstatus = 'F' AS has_date_key, o_custkey % 3 > 0 AS queried_by_date
    FROM orders
"""


@plan(
    "layout_findings",
    f"""
    WITH flags AS (SELECT table_name, partition_levels = 0 AS not_partitioned, partition_levels > 3 AS over_partitioned,
      format IN ('csv', 'json') AS text_format, size_gb > 100 AS very_large, size_gb < 10 AS small_files,
      queried_by_date AND NOT has_date_key AS date_key_missing FROM ({TABLE_META})),
    counted AS (SELECT *, not_partitioned::INT + over_partitioned::INT + text_format::INT + very_large::INT + small_files::INT AS n_issues FROM flags)
    SELECT *, CASE WHEN n_issues >= 5 THEN 'HIGH' WHEN n_issues >= 3 THEN 'MEDIUM' WHEN n_issues >= 1 THEN 'LOW' ELSE 'NONE' END AS priority
    FROM counted
    """,
)
def layout_findings(t: Tables) -> DataFrame:
    return ly.layout_findings(from_sql(t, TABLE_META, "orders"))


@plan(
    "layout_portfolio",
    f"""
    SELECT SUM(CAST(size_gb AS DECIMAL(18,6))) * 1024 > 10000 AS large_estate, bool_or(format = 'csv') AS convert_csv,
           bool_or(format = 'delta') AS use_delta_features, bool_or(partition_levels > 0) AS use_pruning FROM ({TABLE_META})
    """,
)
def layout_portfolio(t: Tables) -> DataFrame:
    return ly.portfolio_advice(from_sql(t, TABLE_META, "orders"))


# A log of queries, one per order, over one table per customer.
QUERY_LOG = """
    SELECT concat('sales_', CAST(o_custkey AS VARCHAR(20))) AS table_name,
      CASE o_orderpriority
        WHEN '1-URGENT' THEN 'select sum(x) from sales where order_date >= 1 and status = 2'
        WHEN '2-HIGH' THEN 'select * from sales s join regions r on s.region_id = r.id where r.country = 1'
        WHEN '3-MEDIUM' THEN 'SELECT a FROM sales WHERE Event_Time < 5 AND load_year = 2024'
        WHEN '4-NOT SPECIFIED' THEN 'select a from sales s join customers c on s.cust_id = c.id'
        ELSE 'select 1 from sales' END AS sql
    FROM orders
"""


@plan(
    "partition_from_query_log",
    f"""
    SELECT table_name, COUNT(*) AS n_queries, COUNT(*) FILTER (regexp_matches(lower(sql), 'date|timestamp')) AS n_date,
           COUNT(*) FILTER (regexp_matches(lower(sql), 'region|country')) AS n_place,
           COUNT(*) FILTER (regexp_matches(lower(sql), 'date|timestamp')) > 0 AS by_date,
           COUNT(*) FILTER (regexp_matches(lower(sql), 'region|country')) > 0 AS by_place
    FROM ({QUERY_LOG}) GROUP BY table_name
    """,
)
def partition_from_query_log(t: Tables) -> DataFrame:
    return ly.partition_advice_from_log(from_sql(t, QUERY_LOG, "orders"))


@plan(
    "partition_column_choice",
    f"""
    WITH log AS ({QUERY_LOG}),
    uses AS (SELECT table_name, unnest(regexp_extract_all(regexp_extract(lower(sql), '\\bwhere\\b(.*)', 1),
                    '(\\w*(?:date|time|year|month)\\w*)', 1)) AS column_name, 'filter' AS role FROM log
             UNION ALL SELECT table_name, unnest(regexp_extract_all(lower(sql), '\\bon\\s+\\w+\\.(\\w+)\\s*=', 1)), 'join' FROM log),
    counted AS (SELECT table_name, column_name, role, COUNT(*) AS uses FROM uses GROUP BY ALL),
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY table_name ORDER BY NOT regexp_matches(column_name, 'date|time|year|month'),
               role <> 'filter', uses DESC, column_name) AS rn FROM counted),
    sizes AS (SELECT concat('sales_', CAST(o_custkey AS VARCHAR(20))) AS table_name, SUM(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / 100 AS size_mb
              FROM orders GROUP BY 1)
    SELECT table_name, column_name, CASE WHEN contains(column_name, 'date') THEN 'range' ELSE 'hash' END AS kind,
           CAST(LEAST(200, GREATEST(10, floor(size_mb / 100))) AS BIGINT) AS n_partitions
    FROM ranked JOIN sizes USING (table_name) WHERE rn = 1
    """,
)
def partition_column_choice(t: Tables) -> DataFrame:
    log = from_sql(t, QUERY_LOG, "orders")
    sizes = t.orders.groupBy(F.concat(F.lit("sales_"), F.col("o_custkey").cast("string")).alias("table_name")).agg(
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 100).alias("size_mb")
    )
    return ly.choose_partition_column(ly.column_usage(log), sizes)


@plan(
    "partition_profile",
    """
    SELECT l_suppkey, COUNT(*) AS n_rows, (SELECT COUNT(DISTINCT l_suppkey) FROM lineitem) AS n_values,
           COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM lineitem) AS share,
           (COUNT(*) * (SELECT COUNT(DISTINCT l_suppkey) FROM lineitem))::DOUBLE / (SELECT COUNT(*) FROM lineitem) AS skew
    FROM lineitem GROUP BY l_suppkey
    """,
)
def partition_profile(t: Tables) -> DataFrame:
    return ly.partition_profile(t.lineitem, "l_suppkey")


@plan("partition_pruned_read", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partition_pruned_read(t: Tables) -> DataFrame:
    path = write_table(t.orders, scratch_path(t.spark, "by-status"), partition_by=["o_orderstatus"])
    back = read_table(t.spark, path)
    return back.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice", "o_orderstatus")


# Every ordered column of the given tables; numbers with a fraction are shown with four digits.
STAT_COLUMNS = {name: [c for c in columns_of(name) if not c[1].startswith("array")] for name in TABLES}


def _shown(column: str, kind: str) -> str:
    return f"CAST({column} AS DECIMAL(28, 4))" if kind == "double" else column


@plan(
    "table_stats",
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_nulls, "
        f"CAST(MIN({_shown(c, kind)}) AS VARCHAR) AS low, CAST(MAX({_shown(c, kind)}) AS VARCHAR) AS high FROM {table}"
        for table, columns in STAT_COLUMNS.items()
        for c, kind in columns
    ),
)
def table_stats(t: Tables) -> DataFrame:
    def stats(name: str) -> DataFrame:
        columns = STAT_COLUMNS[name]
        shown = getattr(t, name).select(*[F.expr(_shown(c, kind)).alias(c) for c, kind in columns])
        return ly.column_stats(shown, name, [c for c, _ in columns])

    return reduce(DataFrame.unionByName, [stats(name) for name in STAT_COLUMNS])


ORDER_COLUMNS = [c for c, _ in STAT_COLUMNS["orders"]]


def _grown(t: Tables) -> DataFrame:
    """Statistics of a copy of ``orders`` that is refreshed, grows by a third, and is refreshed again."""
    copy, store = scratch_path(t.spark, "grown"), scratch_path(t.spark, "sketches")
    for part in ("o_orderkey % 3 > 0", "o_orderkey % 3 = 0"):
        t.orders.where(part).write.mode("append").parquet(copy)
        sk.refresh(t.spark, copy, store)
    return sk.merged(t.spark, copy, store)


@plan(
    "stats_merged",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_nulls, "
        f"CAST(MIN({c}) AS VARCHAR) AS low, CAST(MAX({c}) AS VARCHAR) AS high FROM orders"
        for c in ORDER_COLUMNS
    ),
)
def stats_merged(t: Tables) -> DataFrame:
    return _grown(t).select("column_name", "n_rows", "n_nulls", "low", "high")


# Estimates: tests hold them against exact values.
@plan("stats_estimates")
def stats_estimates(t: Tables) -> DataFrame:
    return _grown(t).select("column_name", "n_distinct", "quartiles")


@plan("table_sizes")
def table_sizes(t: Tables) -> DataFrame:
    return ly.table_sizes(t.spark, {name: t.path(name) for name in STAT_COLUMNS})


@plan(
    "filter_selectivity",
    """
    WITH c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (o_orderstatus = 'F') AS a, COUNT(*) FILTER (o_totalprice > 250000) AS b,
                      COUNT(*) FILTER (o_orderpriority LIKE '1%') AS d FROM orders)
    SELECT 'finished' AS predicate, a AS kept, a::DOUBLE / n AS share FROM c UNION ALL
    SELECT 'expensive', b, b::DOUBLE / n FROM c UNION ALL SELECT 'urgent', d, d::DOUBLE / n FROM c
    """,
)
def filter_selectivity(t: Tables) -> DataFrame:
    return ly.filter_selectivity(
        t.orders,
        {
            "finished": F.col("o_orderstatus") == "F",
            "expensive": F.col("o_totalprice") > 250000,
            "urgent": F.col("o_orderpriority").like("1%"),
        },
    )


@plan(
    "agg_reduction",
    """
    SELECT COUNT(*) AS n_groups, CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*)::DOUBLE / SUM(n) AS reduction
    FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    """,
)
def agg_reduction(t: Tables) -> DataFrame:
    return ly.agg_reduction(t.lineitem, ["l_orderkey", "l_linenumber"])
