"""Joins: kinds, conditions, subquery forms, physical strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from millrace.operators import joins as jn
from millrace.operators.expressions import cast_to
from millrace.operators.hotkeys import spread_join
from millrace.plans.registry import Tables, plan

CUST_ORDER = [("c_custkey", "o_custkey")]


@plan(
    "join_inner",
    "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
)
def join_inner(t: Tables) -> DataFrame:
    o, c = t.orders.alias("o"), t.customer.alias("c")
    joined = o.join(c, F.col("o.o_custkey") == F.col("c.c_custkey"), "inner")
    return joined.select("o.o_orderkey", "c.c_name", "o.o_totalprice")


@plan(
    "join_left",
    """
    SELECT c_custkey, c_name, o_orderkey FROM customer
    LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey
    """,
)
def join_left(t: Tables) -> DataFrame:
    big = t.orders.where(F.col("o_totalprice") > 400000).select("o_custkey", "o_orderkey")
    customers = t.customer.select("c_custkey", "c_name")
    return jn.outer_join(customers, big, CUST_ORDER, "left").select("c_custkey", "c_name", "o_orderkey")


@plan(
    "join_right",
    """
    SELECT o_orderkey, o_totalprice, c_custkey
    FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') RIGHT JOIN customer ON o_custkey = c_custkey
    """,
)
def join_right(t: Tables) -> DataFrame:
    pending = t.orders.where(F.col("o_orderstatus") == "P").select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )
    joined = jn.outer_join(pending, t.customer.select("c_custkey"), [("o_custkey", "c_custkey")], "right")
    return joined.select("o_orderkey", "o_totalprice", "c_custkey")


@plan(
    "join_full",
    """
    SELECT c_custkey, c_acctbal, o_orderkey, o_custkey
    FROM (SELECT * FROM customer WHERE c_acctbal > 0)
    FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey
    """,
)
def join_full(t: Tables) -> DataFrame:
    solvent = t.customer.where(F.col("c_acctbal") > 0).select("c_custkey", "c_acctbal")
    big = t.orders.where(F.col("o_totalprice") > 300000).select("o_orderkey", "o_custkey")
    return jn.outer_join(solvent, big, CUST_ORDER, "full").select(
        "c_custkey", "c_acctbal", "o_orderkey", "o_custkey"
    )


@plan("join_cross", "SELECT c_custkey, r_regionkey, r_name FROM customer CROSS JOIN region")
def join_cross(t: Tables) -> DataFrame:
    return jn.pair_with_all(t.customer.select("c_custkey"), t.region)


@plan(
    "join_composite",
    """
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, n_same, top_price
    FROM lineitem l JOIN (SELECT l_orderkey AS k1, l_linenumber AS k2, COUNT(*) AS n_same,
                                 MAX(l_extendedprice) AS top_price FROM lineitem GROUP BY 1, 2)
    ON l.l_orderkey = k1 AND l.l_linenumber = k2
    """,
)
def join_composite(t: Tables) -> DataFrame:
    per_line = t.lineitem.groupBy(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2")
    ).agg(F.count(F.lit(1)).alias("n_same"), F.max("l_extendedprice").alias("top_price"))
    lines = t.lineitem
    cond = jn.key_condition(lines, per_line, [("l_orderkey", "k1"), ("l_linenumber", "k2")])
    return lines.join(per_line, cond).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_same", "top_price"
    )


@plan(
    "join_literal_pred",
    """
    SELECT c_custkey, o_orderkey FROM customer
    LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'
    """,
)
def join_literal_pred(t: Tables) -> DataFrame:
    # a constant test on the outer-joined side belongs before the join, not after it
    finished = t.orders.where(F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")
    joined = jn.outer_join(t.customer.select("c_custkey"), finished, CUST_ORDER, "left")
    return joined.select("c_custkey", "o_orderkey")


@plan(
    "join_cast_key",
    """
    SELECT o_orderkey, c_name FROM orders
    JOIN (SELECT CAST(c_custkey AS VARCHAR) AS code, c_name FROM customer)
    ON o_custkey = CAST(code AS BIGINT)
    """,
)
def join_cast_key(t: Tables) -> DataFrame:
    coded = t.customer.select(cast_to("c_custkey", "varchar").alias("code"), "c_name")
    cond = F.col("o_custkey") == cast_to("code", "bigint")
    return t.orders.join(coded, cond).select("o_orderkey", "c_name")


@plan(
    "join_theta",
    """
    SELECT p_brand, COUNT(*) AS n, MAX(l_extendedprice) AS top_price
    FROM lineitem JOIN part ON l_partkey = p_partkey AND l_extendedprice > p_retailprice * p_size
    GROUP BY p_brand
    """,
)
def join_theta(t: Tables) -> DataFrame:
    # the equality carries the join; the inequality is a residual test on matched rows
    cond = (F.col("l_partkey") == F.col("p_partkey")) & (
        F.col("l_extendedprice") > F.col("p_retailprice") * F.col("p_size")
    )
    return (
        t.lineitem.join(t.part, cond)
        .groupBy("p_brand")
        .agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("top_price"))
    )


@plan(
    "join_chain",
    """
    SELECT r_name, o_orderpriority, COUNT(*) AS n_lines,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, o_orderpriority
    """,
)
def join_chain(t: Tables) -> DataFrame:
    c = F.col
    # sums per order first: fewer rows reach the four joins, and no order is hot any more
    lines = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(c("l_extendedprice").cast("decimal(18,2)")).alias("amount"),
    )
    return (
        lines.join(t.orders, c("l_orderkey") == c("o_orderkey"))
        .join(t.customer, c("o_custkey") == c("c_custkey"))
        .join(t.nation, c("c_nationkey") == c("n_nationkey"), "left")
        .join(t.region, c("n_regionkey") == c("r_regionkey"), "left")
        .groupBy("r_name", "o_orderpriority")
        .agg(F.sum("lines").alias("n_lines"), F.sum("amount").cast("double").alias("gross"))
    )


@plan(
    "semi_join_in",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)
    """,
)
def semi_join_in(t: Tables) -> DataFrame:
    buyers = t.orders.where(F.col("o_totalprice") > 250000).select("o_custkey").distinct()
    return spread_join(t.customer, buyers, CUST_ORDER, "left_semi", right_unique=True).select("c_custkey", "c_name")


@plan(
    "anti_join_not_in",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
    """,
)
def anti_join_not_in(t: Tables) -> DataFrame:
    big = t.orders.where(F.col("o_totalprice") > 400000)
    return jn.unmatched(t.customer, big, CUST_ORDER).select("c_custkey", "c_name")


# rows to look up, and three lists of values: with a null, without one, and none at all
_LISTS = """
    lists AS (
        SELECT 'with null' AS list, CASE WHEN o_custkey % 7 > 0 THEN o_custkey END AS v FROM orders WHERE o_totalprice > 300000
        UNION ALL SELECT 'known', o_custkey FROM orders WHERE o_totalprice > 300000),
    people AS (SELECT CASE WHEN c_custkey % 11 > 0 THEN c_custkey END AS k, c_name FROM customer)
"""


@plan(
    "not_in_nulls",
    f"""
    WITH {_LISTS}
    SELECT 'with null' AS list, k, c_name FROM people WHERE k NOT IN (SELECT v FROM lists WHERE list = 'with null')
    UNION ALL SELECT 'known', k, c_name FROM people WHERE k NOT IN (SELECT v FROM lists WHERE list = 'known')
    UNION ALL SELECT 'empty', k, c_name FROM people WHERE k NOT IN (SELECT v FROM lists WHERE list = 'empty')
    """,
)
def not_in_nulls(t: Tables) -> DataFrame:
    people = t.customer.select(F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey")).alias("k"), "c_name")
    known = t.orders.where(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("v"))
    lists = {"with null": known.select(F.when(F.col("v") % 7 > 0, F.col("v")).alias("v")), "known": known, "empty": known.limit(0)}
    parts = [jn.not_in(people, "k", values, "v").select(F.lit(name).alias("list"), "k", "c_name") for name, values in lists.items()]
    return reduce(DataFrame.unionAll, parts)


@plan(
    "scalar_subquery",
    """
    SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders
    FROM customer
    """,
)
def scalar_subquery(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return jn.outer_join(t.customer.select("c_custkey"), counts, CUST_ORDER, "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_orders")
    )


@plan(
    "derived_table",
    """
    SELECT x.o_custkey, x.total FROM
    (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total FROM orders GROUP BY o_custkey) x
    WHERE x.total > 1000000
    """,
)
def derived_table(t: Tables) -> DataFrame:
    x = (
        t.orders.groupBy("o_custkey")
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
        .alias("x")
    )
    return x.where(F.col("x.total") > 1000000).select("x.o_custkey", "x.total")


STRATEGY_AGG = """COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity"""


def _by(joined: DataFrame, key: str) -> DataFrame:
    return joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
    )


@plan(
    "join_broadcast",
    f"SELECT s_nationkey, {STRATEGY_AGG} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
)
def join_broadcast(t: Tables) -> DataFrame:
    suppliers = t.supplier.select("s_suppkey", "s_nationkey")
    return _by(jn.checked_broadcast_join(t.lineitem, suppliers, [("l_suppkey", "s_suppkey")]), "s_nationkey")


@plan(
    "join_sort_merge",
    f"SELECT o_orderpriority, {STRATEGY_AGG} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def join_sort_merge(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderpriority").hint("merge")
    joined = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return _by(joined, "o_orderpriority")


@plan(
    "join_shuffle_hash",
    """
    SELECT c_mktsegment, COUNT(*) AS n, MAX(o_totalprice) AS top_price
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
    """,
)
def join_shuffle_hash(t: Tables) -> DataFrame:
    segments = t.customer.select("c_custkey", "c_mktsegment").hint("shuffle_hash")
    joined = t.orders.join(segments, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top_price")
    )


@plan(
    "join_size_aware",
    f"SELECT p_brand, {STRATEGY_AGG} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def join_size_aware(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_partkey", "l_quantity")
    parts = t.part.select("p_partkey", "p_brand")
    return _by(jn.size_aware_join(lines, parts, [("l_partkey", "p_partkey")]), "p_brand")
