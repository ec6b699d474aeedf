"""Grouped and global aggregates, duplicate removal, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import aggregates as ag
from millrace.operators.joins import outer_join
from millrace.operators.windows import latest_per_key, ordering
from millrace.plans.registry import Tables, plan


def money(column: str):
    """Exact sum of a two-decimal column, as double."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


@plan("count_star", "SELECT COUNT(*) AS n FROM orders")
def count_star(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("n"))


@plan(
    "count_column",
    """
    SELECT c_nationkey, COUNT(*) AS n_rows, COUNT(o_orderkey) AS n_orders
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY 1
    """,
)
def count_column(t: Tables) -> DataFrame:
    big = t.orders.where(F.col("o_totalprice") > 400000).select("o_custkey", "o_orderkey")
    joined = outer_join(t.customer, big, [("c_custkey", "o_custkey")], "left")
    return joined.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("o_orderkey").alias("n_orders")
    )


@plan(
    "count_distinct",
    "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type",
)
def count_distinct(t: Tables) -> DataFrame:
    return ag.distinct_count(t.events, ["event_type"], "user_id", "users")


@plan(
    "basic_aggs",
    """
    SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total,
           CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_quantity) AS mean,
           MIN(l_quantity) AS low, MAX(l_quantity) AS high
    FROM lineitem GROUP BY l_returnflag
    """,
)
def basic_aggs(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        money("l_quantity").alias("total"),
        (money("l_quantity") / F.count("l_quantity")).alias("mean"),
        F.min("l_quantity").alias("low"),
        F.max("l_quantity").alias("high"),
    )


@plan(
    "global_agg",
    """
    SELECT COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
           MIN(o_orderkey) AS low, MAX(o_orderkey) AS high FROM orders
    """,
)
def global_agg(t: Tables) -> DataFrame:
    return t.orders.agg(
        F.count(F.lit(1)).alias("n"),
        money("o_totalprice").alias("total"),
        F.min("o_orderkey").alias("low"),
        F.max("o_orderkey").alias("high"),
    )


@plan(
    "group_by_multi",
    """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n,
           CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc,
           CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS avg_disc
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus
    """,
)
def group_by_multi(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice").cast("decimal(12,2)") * (
        F.lit(1) - F.col("l_discount").cast("decimal(4,2)")
    )
    cut = F.lit("2000-09-02").cast("timestamp_ntz")
    return (
        t.lineitem.where(F.col("l_shipdate") <= cut)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("n"),
            money("l_quantity").alias("sum_qty"),
            money("l_extendedprice").alias("sum_base"),
            F.sum(net).cast("double").alias("sum_disc"),
            (money("l_discount") / F.count(F.lit(1))).alias("avg_disc"),
        )
    )


@plan(
    "group_by_ordinal",
    "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1, 2",
)
def group_by_ordinal(t: Tables) -> DataFrame:
    return t.spark.sql(
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1, 2",
        orders=t.orders,
    )


@plan(
    "having",
    """
    SELECT o_custkey, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND SUM(CAST(o_totalprice AS DECIMAL(18,2))) > 2000000
    """,
)
def having(t: Tables) -> DataFrame:
    per_customer = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), money("o_totalprice").alias("total")
    )
    return per_customer.where((F.col("n") > 10) & (F.col("total") > 2000000))


@plan(
    "conditional_agg",
    """
    SELECT o_orderpriority, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished,
           CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS open_total
    FROM orders GROUP BY o_orderpriority
    """,
)
def conditional_agg(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return t.orders.groupBy("o_orderpriority").agg(
        F.sum(F.when(status == "F", 1).otherwise(0)).alias("finished"),
        F.sum(F.when(status == "O", price).otherwise(0)).cast("double").alias("open_total"),
    )


@plan(
    "string_agg",
    """
    SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities
    FROM orders GROUP BY o_custkey
    """,
)
def string_agg(t: Tables) -> DataFrame:
    return ag.string_agg(t.orders, ["o_custkey"], "o_orderpriority", "priorities", ", ")


@plan(
    "array_agg",
    """
    SELECT l_orderkey, array_to_string(list_sort(array_agg(DISTINCT l_linenumber)), ',') AS line_numbers
    FROM lineitem GROUP BY l_orderkey
    """,
)
def array_agg(t: Tables) -> DataFrame:
    lists = ag.array_agg(t.lineitem, ["l_orderkey"], "l_linenumber", "numbers")
    text = F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",")
    return lists.select("l_orderkey", text.alias("line_numbers"))


@plan(
    "safe_ratio",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ROUND(l_tax / NULLIF(l_discount, 0), 2) AS tax_per_discount
    FROM lineitem
    """,
)
def safe_ratio(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        ag.safe_ratio("l_tax", "l_discount", 2).alias("tax_per_discount"),
    )


@plan(
    "drop_duplicates",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity,
             l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem)
    WHERE rn = 1
    """,
)
def drop_duplicates(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    rest = [(c, True) for c in (
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )]
    kept = latest_per_key(t.lineitem, keys, rest)
    return kept.select(*keys, "l_partkey", "l_suppkey", "l_quantity")


@plan("distinct_rows", "SELECT DISTINCT user_id, event_type FROM events")
def distinct_rows(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type").dropDuplicates()


@plan(
    "order_by",
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey",
)
def order_by(t: Tables) -> DataFrame:
    keys = [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", True)]
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(*ordering(keys))


@plan(
    "order_by_ordinal",
    "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1",
)
def order_by_ordinal(t: Tables) -> DataFrame:
    return t.spark.sql(
        "SELECT o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1 ORDER BY 2 DESC, 1",
        orders=t.orders,
    )


@plan("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t: Tables) -> DataFrame:
    return ag.top_k(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", False), ("o_orderkey", True)], 20)


@plan("rownum_limit", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50")
def rownum_limit(t: Tables) -> DataFrame:
    return ag.top_k(t.customer.select("c_custkey", "c_name"), [("c_custkey", True)], 50)
