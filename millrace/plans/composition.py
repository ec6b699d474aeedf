"""Common table expressions, hierarchies, unions, pivots, merge, plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import cdc
from millrace.operators.file_table import FileTable
from millrace.operators.hierarchy import hierarchy, levels
from millrace.plans.aggregates import money
from millrace.plans.derived import CUSTOMER_CHANGES, customer_changes, from_sql
from millrace.plans.registry import Tables, plan
from millrace.session import scratch_path


@plan(
    "cte",
    """
    WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000)
    SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey
    """,
)
def cte(t: Tables) -> DataFrame:
    big = t.orders.where(F.col("o_totalprice") > 200000).select("o_custkey", "o_totalprice")
    return big.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "cte_chain",
    """
    WITH per_customer AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE AS total FROM orders GROUP BY 1),
         top AS (SELECT MAX(total) AS best FROM per_customer),
         ranked AS (SELECT o_custkey, total, total / best AS share FROM per_customer, top)
    SELECT * FROM ranked
    """,
)
def cte_chain(t: Tables) -> DataFrame:
    # used twice; both uses have the same shuffle, which Spark runs once (ReusedExchange)
    per_customer = t.orders.groupBy("o_custkey").agg(money("o_totalprice").alias("total"))
    return t.spark.sql(
        "WITH top AS (SELECT max(total) AS best FROM {per_customer}) "
        "SELECT o_custkey, total, total / (SELECT best FROM top) AS share FROM {per_customer}",
        per_customer=per_customer,
    )


TREE = """
    WITH RECURSIVE nodes AS (
      SELECT c_custkey AS id, c_name AS name,
             CASE WHEN c_custkey = 0 THEN NULL ELSE CAST(floor(c_custkey / 10) AS BIGINT) END AS parent_id
      FROM customer),
    walk AS (
      SELECT id, parent_id, 1 AS level, id AS root, CAST(id AS VARCHAR) AS path FROM nodes WHERE parent_id IS NULL
      UNION ALL
      SELECT n.id, n.parent_id, w.level + 1, w.root, w.path || '/' || CAST(n.id AS VARCHAR)
      FROM nodes n JOIN walk w ON n.parent_id = w.id)
"""


def _tree(t: Tables) -> DataFrame:
    parent = F.when(F.col("c_custkey") == 0, F.lit(None)).otherwise(
        F.floor(F.col("c_custkey") / 10).cast("bigint")
    )
    nodes = t.customer.select(F.col("c_custkey").alias("id"), parent.alias("parent_id"))
    return hierarchy(nodes, "id", "parent_id", F.col("parent_id").isNull())


@plan("recursive_cte", TREE + "SELECT id, parent_id, level FROM walk")
def recursive_cte(t: Tables) -> DataFrame:
    return _tree(t).select(F.col("node").alias("id"), F.col("parent").alias("parent_id"), "level")


@plan("connect_by", TREE + "SELECT id, level, root, path FROM walk")
def connect_by(t: Tables) -> DataFrame:
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "/")
    return _tree(t).select(F.col("node").alias("id"), "level", "root", path.alias("path"))


# Chains of 300 customers, each below the one before, and pairs of suppliers that are each other's parent.
DEEP_NODES = """
    SELECT c_custkey AS id, CASE WHEN c_custkey % 300 = 0 THEN NULL ELSE c_custkey - 1 END AS parent_id FROM customer
    UNION ALL SELECT -1 - s_suppkey, -2 - s_suppkey + 2 * (s_suppkey % 2) FROM supplier
"""


@plan(
    "recursive_deep",
    f"""
    WITH RECURSIVE nodes AS ({DEEP_NODES}),
    walk AS (SELECT id, CAST(1 AS BIGINT) AS level, id AS root FROM nodes WHERE parent_id IS NULL
             UNION ALL SELECT n.id, w.level + 1, w.root FROM nodes n JOIN walk w ON n.parent_id = w.id)
    SELECT n.id, n.parent_id, w.level, w.root, w.id IS NULL AS cyclic FROM nodes n LEFT JOIN walk w ON n.id = w.id
    """,
)
def recursive_deep(t: Tables) -> DataFrame:
    nodes = from_sql(t, DEEP_NODES, "customer", "supplier")
    found = levels(nodes, "id", "parent_id", F.col("parent_id").isNull())
    return found.select(F.col("node").alias("id"), F.col("parent").alias("parent_id"), "level", "root", "cyclic")


@plan(
    "union_all",
    """
    SELECT c_custkey AS party, c_name AS name, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier
    """,
)
def union_all(t: Tables) -> DataFrame:
    buyers = t.customer.select(
        F.col("c_custkey").alias("party"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    sellers = t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("party"))
    return buyers.unionByName(sellers, allowMissingColumns=True)


@plan(
    "pivot",
    """
    SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, COUNT(*) FILTER (o_orderstatus = 'F') AS f,
           COUNT(*) FILTER (o_orderstatus = 'O') AS o, COUNT(*) FILTER (o_orderstatus = 'P') AS p
    FROM orders GROUP BY 1
    """,
)
def pivot(t: Tables) -> DataFrame:
    # the values are named, so no extra job looks for them
    wide = (
        t.orders.groupBy(F.year("o_orderdate").alias("year"))
        .pivot("o_orderstatus", ["F", "O", "P"])
        .agg(F.count(F.lit(1)))
    )
    return wide.select("year", *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s.lower()) for s in "FOP"])


@plan(
    "unpivot",
    """
    SELECT l_returnflag, measure, COUNT(*) AS n, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM (SELECT l_returnflag, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem
          UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem
          UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem
          UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem) GROUP BY 1, 2
    """,
)
def unpivot(t: Tables) -> DataFrame:
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = t.lineitem.unpivot(["l_returnflag"], measures, "measure", "amount")
    return long.groupBy("l_returnflag", "measure").agg(
        F.count(F.lit(1)).alias("n"), money("amount").alias("total")
    )


@plan(
    "merge_into",
    f"""
    WITH changes AS ({CUSTOMER_CHANGES}),
    last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY seq DESC, tie DESC) AS rn FROM changes) WHERE rn = 1)
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM last
    UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM last)
    """,
)
def merge_into(t: Tables) -> DataFrame:
    """Only the files of the target that hold a changed key are written anew."""
    table = FileTable(t.spark, scratch_path(t.spark, "merge-target"), t.customer.schema, ["c_custkey"])
    table.create(t.customer)
    table.upsert(customer_changes(t), [("seq", False), ("tie", False)])
    return table.read().select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@plan(
    "merge_frames",
    f"""
    WITH changes AS ({CUSTOMER_CHANGES}),
    last AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY seq DESC, tie DESC) AS rn FROM changes) WHERE rn = 1)
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM last
    UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM last)
    """,
)
def merge_frames(t: Tables) -> DataFrame:
    """The same merge as a frame, for targets that are not files."""
    return cdc.merge(
        t.customer, customer_changes(t), ["c_custkey"], [("seq", False), ("tie", False)]
    )


@plan(
    "sql_passthrough",
    """
    SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS n
    FROM customer, orders, lineitem
    WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
      AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
    GROUP BY l_orderkey
    """,
)
def sql_passthrough(t: Tables) -> DataFrame:
    return t.spark.sql(
        """
        SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS n
        FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP_NTZ '1998-03-15'
          AND l_shipdate > TIMESTAMP_NTZ '1998-03-15'
        GROUP BY l_orderkey
        """,
        customer=t.customer,
        orders=t.orders,
        lineitem=t.lineitem,
    )
