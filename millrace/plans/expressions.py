"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import expressions as ex
from millrace.operators.joins import outer_join
from millrace.plans.registry import Tables, plan


@plan("select_columns", "SELECT c.c_custkey, c.c_name, c.c_mktsegment FROM customer c")
def select_columns(t: Tables) -> DataFrame:
    return t.customer.alias("c").select("c.c_custkey", "c.c_name", "c.c_mktsegment")


@plan("select_star", "SELECT s.* FROM supplier s")
def select_star(t: Tables) -> DataFrame:
    return t.supplier.alias("s").select("s.*")


@plan("select_alias", "SELECT c_custkey AS id, c_acctbal * 2 AS doubled FROM customer")
def select_alias(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 2).alias("doubled")
    )


@plan(
    "lateral_alias",
    """
    SELECT o_orderstatus, COUNT(*) AS total, COUNT(*) * 100 AS scaled
    FROM orders GROUP BY o_orderstatus
    """,
)
def lateral_alias(t: Tables) -> DataFrame:
    return t.spark.sql(
        "SELECT o_orderstatus, count(*) AS total, total * 100 AS scaled FROM {orders} GROUP BY 1",
        orders=t.orders,
    )


@plan(
    "arithmetic",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 1 AS plus, l_quantity - 1 AS minus,
           l_extendedprice * l_discount AS rebate, l_linenumber / 4 AS quarter,
           CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS per_discount
    FROM lineitem
    """,
)
def arithmetic(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        (F.col("l_quantity") + 1).alias("plus"),
        (F.col("l_quantity") - 1).alias("minus"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("rebate"),
        (F.col("l_linenumber") / 4).alias("quarter"),
        F.try_divide("l_extendedprice", "l_discount").alias("per_discount"),
    )


@plan("literals", "SELECT c_custkey, 'fixed' AS word, 7 AS number, 2.5::DOUBLE AS ratio FROM customer")
def literals(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", F.lit("fixed").alias("word"), F.lit(7).alias("number"), F.lit(2.5).alias("ratio")
    )


@plan(
    "cast_types",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2))::VARCHAR AS price,
           CAST(l_quantity AS INTEGER) AS quantity, CAST(l_linenumber AS BIGINT) AS line,
           CAST(l_partkey AS VARCHAR) AS part, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship_day,
           TRY_CAST(l_returnflag AS INTEGER) AS bad
    FROM lineitem
    """,
)
def cast_types(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        ex.cast_to("l_extendedprice", "decimal(18,2)").cast("string").alias("price"),
        ex.cast_to("l_quantity", "int").alias("quantity"),
        ex.cast_to("l_linenumber", "bigint").alias("line"),
        ex.cast_to("l_partkey", "varchar").alias("part"),
        ex.cast_to("l_shipdate", "date").cast("string").alias("ship_day"),
        ex.cast_to("l_returnflag", "int", strict=False).alias("bad"),
    )


@plan(
    "case_when",
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid'
                            ELSE 'low' END AS band FROM orders
    """,
)
def case_when(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    band = F.when(price > 300000, "high").when(price > 100000, "mid").otherwise("low")
    return t.orders.select("o_orderkey", band.alias("band"))


@plan(
    "filter_bool",
    """
    SELECT o_orderkey FROM orders
    WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT (o_orderpriority = '5-LOW')
    """,
)
def filter_bool(t: Tables) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    wanted = ((status == "F") | (price > 200000)) & ~(F.col("o_orderpriority") == "5-LOW")
    return t.orders.where(wanted).select("o_orderkey")


@plan(
    "filter_compare",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
    WHERE l_discount >= l_tax AND l_quantity <> 7 AND l_quantity <= 40 AND l_linenumber < 6
      AND l_extendedprice > 1000 AND l_returnflag = 'N'
    """,
)
def filter_compare(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.where(
        (c("l_discount") >= c("l_tax"))
        & (c("l_quantity") != 7)
        & (c("l_quantity") <= 40)
        & (c("l_linenumber") < 6)
        & (c("l_extendedprice") > 1000)
        & (c("l_returnflag") == "N")
    ).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@plan(
    "filter_like",
    "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%' AND p_name NOT LIKE 'red%'",
)
def filter_like(t: Tables) -> DataFrame:
    name = F.col("p_name")
    return t.part.where(name.like("%ring%") & ~name.like("red%")).select("p_partkey", "p_name")


@plan(
    "filter_in",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def filter_in(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        "o_orderkey", "o_orderpriority"
    )


@plan(
    "filter_null",
    """
    SELECT c_custkey, o_orderkey, o_orderkey IS NULL AS missing
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'
    WHERE o_orderkey IS NULL OR o_orderpriority IS NOT NULL
    """,
)
def filter_null(t: Tables) -> DataFrame:
    orders = t.orders.where(F.col("o_orderstatus") == "P")
    joined = outer_join(t.customer, orders, [("c_custkey", "o_custkey")], "left")
    return joined.where(F.col("o_orderkey").isNull() | F.col("o_orderpriority").isNotNull()).select(
        "c_custkey", "o_orderkey", F.col("o_orderkey").isNull().alias("missing")
    )


@plan(
    "filter_recent",
    """
    SELECT event_id, event_type FROM events
    WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 36 HOUR
       OR ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 29 DAY
    """,
)
def filter_recent(t: Tables) -> DataFrame:
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    recent = ex.within("ts", as_of, 36, "hours")
    oldest = ~ex.within("ts", as_of, 29, "days")
    return t.events.where(recent | oldest).select("event_id", "event_type")


@plan(
    "with_processed_ts",
    """
    SELECT event_id, value, '2024-01-31 12:00:00' AS processed_at, '2024-01-31' AS processed_date
    FROM events
    """,
)
def with_processed_ts(t: Tables) -> DataFrame:
    run = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    stamped = ex.stamp(t.events, run)
    return stamped.select(
        "event_id",
        "value",
        F.date_format("processed_timestamp", "yyyy-MM-dd HH:mm:ss").alias("processed_at"),
        F.col("processed_date").cast("string").alias("processed_date"),
    )


@plan("drop_columns", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_columns(t: Tables) -> DataFrame:
    return t.customer.drop("c_acctbal", "c_mktsegment")


@plan(
    "select_fields_filter",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000",
)
def select_fields_filter(t: Tables) -> DataFrame:
    return ex.select_where(
        t.orders, ["o_orderkey", "o_totalprice"], F.col("o_totalprice").between(50000, 150000)
    )


@plan(
    "map_records",
    """
    SELECT o_orderkey, upper(o_orderstatus) || '-' || substr(o_orderpriority, 1, 1) AS label,
           o_totalprice * 2 AS doubled
    FROM orders WHERE o_totalprice > 1000
    """,
)
def map_records(t: Tables) -> DataFrame:
    def label(batch):
        batch = batch[batch["o_totalprice"] > 1000]
        return batch.assign(
            label=batch["o_orderstatus"].str.upper() + "-" + batch["o_orderpriority"].str[:1],
            doubled=batch["o_totalprice"] * 2,
        )[["o_orderkey", "label", "doubled"]]

    columns = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    return ex.map_records(
        t.orders.select(*columns), label, "o_orderkey bigint, label string, doubled double"
    )
