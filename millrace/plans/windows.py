"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import windows as wn
from millrace.plans.registry import Tables, plan

BY_DATE = [("o_orderdate", True), ("o_orderkey", True)]
LINE_ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
BY_TIME = [("ts", True), ("event_id", True)]
DAY_MICROS = 24 * 3600 * 1_000_000


@plan(
    "win_row_number",
    """
    SELECT o_custkey, o_orderkey,
           ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders
    """,
)
def win_row_number(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return wn.row_numbers(rows, ["o_custkey"], BY_DATE).drop("o_orderdate")


@plan(
    "win_rank",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           RANK() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS rnk FROM lineitem
    """,
)
def win_rank(t: Tables) -> DataFrame:
    rows = t.lineitem.select(*LINE_ID, "l_quantity")
    return wn.ranks(rows, ["l_suppkey"], [("l_quantity", False)], rank="rnk").drop("l_quantity")


@plan(
    "win_dense_rank",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           DENSE_RANK() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS rnk FROM lineitem
    """,
)
def win_dense_rank(t: Tables) -> DataFrame:
    rows = t.lineitem.select(*LINE_ID, "l_quantity")
    return wn.ranks(rows, ["l_suppkey"], [("l_quantity", False)], dense="rnk").drop("l_quantity")


@plan(
    "win_lead",
    """
    SELECT event_id, user_id, LEAD(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value
    FROM events
    """,
)
def win_lead(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "value")
    return wn.neighbour(rows, ["user_id"], BY_TIME, "value", "next_value", 1).drop("ts", "value")


@plan(
    "win_lag",
    """
    SELECT event_id, user_id, LAG(event_type, 2, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
    FROM events
    """,
)
def win_lag(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    shifted = wn.neighbour(rows, ["user_id"], BY_TIME, "event_type", "before", -2, "none")
    return shifted.drop("ts", "event_type")


@plan(
    "win_agg",
    """
    SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total,
           COUNT(*) OVER w AS n, MIN(o_totalprice) OVER w AS low, MAX(o_totalprice) OVER w AS high,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) / COUNT(*) OVER w AS mean
    FROM orders WINDOW w AS (PARTITION BY o_custkey)
    """,
)
def win_agg(t: Tables) -> DataFrame:
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    aggs = {
        "total": total,
        "n": F.count(F.lit(1)),
        "low": F.min("o_totalprice"),
        "high": F.max("o_totalprice"),
        "mean": total / F.count(F.lit(1)),
    }
    return wn.group_totals(rows, ["o_custkey"], aggs).drop("o_custkey", "o_totalprice")


@plan(
    "win_first_last",
    """
    SELECT event_id, FIRST_VALUE(value) OVER w AS first_value, LAST_VALUE(value) OVER w AS last_value
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def win_first_last(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "value")
    at = F.struct("ts", "event_id")
    aggs = {"first_value": F.min_by("value", at), "last_value": F.max_by("value", at)}
    return wn.group_totals(rows, ["user_id"], aggs).select("event_id", "first_value", "last_value")


@plan(
    "win_frame",
    """
    SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts
           RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS DOUBLE) AS day_sum FROM events
    """,
)
def win_frame(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id",
        "user_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
    )
    summed = wn.range_sum(rows, ["user_id"], "at", DAY_MICROS, "amount", "day_sum")
    return summed.select("event_id", F.col("day_sum").cast("double").alias("day_sum"))


@plan(
    "win_running",
    """
    SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY event_type ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS so_far FROM events
    """,
)
def win_running(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", "event_type", "ts", F.col("value").cast("decimal(18,2)").alias("amount")
    )
    summed = wn.running_sum(rows, ["event_type"], BY_TIME, "amount", "so_far")
    return summed.select("event_id", F.col("so_far").cast("double").alias("so_far"))


@plan(
    "rownum",
    "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
)
def rownum(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    order = [("o_totalprice", False), ("o_orderkey", True)]
    return wn.global_row_numbers(rows, order).select("o_orderkey", "rn")


@plan(
    "top_n_per_group",
    """
    SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rn FROM (SELECT o_custkey, o_orderkey,
      ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    WHERE rn <= 3
    """,
)
def top_n_per_group(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    order = [("o_totalprice", False), ("o_orderkey", True)]
    return wn.top_per_group(rows, ["o_custkey"], order, 3).drop("o_totalprice")
