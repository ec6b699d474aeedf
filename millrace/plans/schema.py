"""Schema inference, comparison and evolution over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from millrace.operators import schema as sc
from millrace.plans.derived import from_sql
from millrace.plans.registry import Tables, plan
from millrace.session import scratch_path
from millrace.sources.files import ensure_database

# Columns of the given tables, as the SQL twins need them spelled out.
TABLES = {
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp "
    "o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double "
    "l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp",
    "events": "event_id:bigint ts:timestamp user_id:bigint event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:array<float> label:int",
    "pages": "page_id:bigint url:string html:string",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "region": "r_regionkey:int r_name:string",
    "benchmark": "item_id:bigint text:string",
    "labels": "doc_id:bigint quality:int toxic:int",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in TABLES[table].split()]


JSON_DOCS = """
    SELECT props AS doc FROM events
    UNION ALL
    SELECT concat('{"id":', CAST(o_orderkey AS VARCHAR(20)), ',"status":"', o_orderstatus, '","day":"', substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10),
                  '","at":"', substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), ' 10:00:00","open":', CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END,
                  ',"ratio":0.5,"mixed":', CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '"x"' END,
                  ',"gap":', CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '7' END, ',"tags":["a"],"empty":[],"sub":{"n":1},"nothing":null}') AS doc
    FROM orders
"""


@plan(
    "infer_schema",
    f"""
    WITH docs AS ({JSON_DOCS}),
    fields AS (SELECT j.key AS field, j.type AS kind, trim(CAST(j.value AS VARCHAR), '"') AS txt,
                      CASE WHEN j.type = 'ARRAY' THEN json_type(j.value, '$[0]') END AS element FROM docs, json_each(docs.doc) AS j),
    typed AS (SELECT field, CASE WHEN kind = 'NULL' THEN NULL WHEN kind = 'BOOLEAN' THEN 'boolean'
        WHEN kind IN ('BIGINT', 'UBIGINT') THEN 'bigint' WHEN kind = 'DOUBLE' THEN 'double' WHEN kind = 'OBJECT' THEN 'struct<>'
        WHEN kind = 'ARRAY' THEN CASE WHEN element IN ('BIGINT', 'UBIGINT') THEN 'array<bigint>' ELSE 'array<string>' END
        WHEN regexp_matches(txt, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND regexp_matches(txt, '[T ]') THEN 'timestamp'
        WHEN regexp_matches(txt, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'date' ELSE 'string' END AS type FROM fields)
    SELECT field, CASE WHEN COUNT(DISTINCT type) = 1 THEN MAX(type) ELSE 'string' END AS type FROM typed GROUP BY field
    """,
)
def infer_schema(t: Tables) -> DataFrame:
    return sc.infer_fields(from_sql(t, JSON_DOCS, "events", "orders"), "doc")


def _all(t: Tables) -> dict[str, DataFrame]:
    return {name: getattr(t, name) for name in TABLES}


def _by_values(table: str, column: str) -> str:
    return f"(COUNT(*) > 10 AND COUNT(DISTINCT {column}) < 0.2 * COUNT(*))"


def _by_name(column: str) -> str:
    return "TRUE" if any(p in column for p in sc.PARTITION_NAME_PARTS) else "FALSE"


@plan(
    "partition_candidates",
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c}' AS field, {_by_name(c)} AS by_name, {_by_values(table, c)} AS by_values FROM {table}"
        for table in TABLES
        for c, _ in columns_of(table)
    ),
)
def partition_candidates(t: Tables) -> DataFrame:
    return sc.column_profile(_all(t)).select("table_name", "field", "by_name", "by_values")


FIELDS = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{c}' AS field, '{kind}' AS type, ({_by_name(c)} OR {_by_values(table, c)}) AS is_partition, "
    f"COUNT(*) AS n_rows FROM {table}"
    for table in TABLES
    for c, kind in columns_of(table)
)


@plan(
    "schema_stats",
    f"""
    SELECT table_name, COUNT(*) AS total_fields, COUNT(*) FILTER (NOT is_partition) AS data_columns,
           COUNT(*) FILTER (is_partition) AS partition_columns, MAX(n_rows) AS n_rows,
           COUNT(*) FILTER (type = 'string') AS n_string, COUNT(*) FILTER (type = 'bigint') AS n_bigint,
           COUNT(*) FILTER (type = 'int') AS n_int, COUNT(*) FILTER (type = 'double') AS n_double,
           COUNT(*) FILTER (type = 'timestamp') AS n_timestamp, COUNT(*) FILTER (NOT is_partition) > 50 AS wide,
           COUNT(*) FILTER (is_partition) = 0 AND MAX(n_rows) > 1000 AS needs_partition,
           COUNT(*) FILTER (NOT is_partition AND (type LIKE '%array%' OR type LIKE '%struct%')) > 0 AS nested,
           COUNT(*) FILTER (NOT is_partition AND type = 'string') > 0.8 * COUNT(*) FILTER (NOT is_partition) AS mostly_strings
    FROM ({FIELDS}) GROUP BY table_name
    """,
)
def schema_stats(t: Tables) -> DataFrame:
    return sc.schema_statistics(sc.table_fields(_all(t)))


# Two catalog snapshots: each customer stands for a table, the priorities of its orders
# before and after 1998 for the columns; the newer one spells some names differently.
OLD_CATALOG = """
    SELECT concat('t', CAST(o_custkey AS VARCHAR(20))) AS table_name, concat('Col', o_orderpriority) AS column_name,
           CASE MIN(o_orderstatus) WHEN 'F' THEN 'string' WHEN 'O' THEN 'int' ELSE 'double' END AS type
    FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1, 2
"""
NEW_CATALOG = """
    SELECT concat('t', CAST(o_custkey AS VARCHAR(20))) AS table_name, concat('col', o_orderpriority) AS column_name,
           CASE MAX(o_orderstatus) WHEN 'F' THEN 'string' WHEN 'O' THEN 'bigint' ELSE 'double' END AS type
    FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1, 2
"""
CHANGES = f"""
    SELECT table_name, column_name, o.type AS old_type, n.type AS new_type,
           CASE WHEN o.type IS NULL THEN 'added' WHEN n.type IS NULL THEN 'removed'
                WHEN o.type <> n.type THEN 'modified' ELSE 'unchanged' END AS change
    FROM (SELECT table_name, lower(column_name) AS column_name, type FROM ({OLD_CATALOG})) o
    FULL JOIN (SELECT table_name, lower(column_name) AS column_name, type FROM ({NEW_CATALOG})) n USING (table_name, column_name)
"""


def _changes(t: Tables) -> DataFrame:
    return sc.diff_columns(from_sql(t, OLD_CATALOG, "orders"), from_sql(t, NEW_CATALOG, "orders"))


@plan("schema_diff", CHANGES)
def schema_diff(t: Tables) -> DataFrame:
    return _changes(t)


@plan(
    "schema_diff_summary",
    f"""
    SELECT table_name, COUNT(*) FILTER (change = 'added') AS added, COUNT(*) FILTER (change = 'removed') AS removed,
           COUNT(*) FILTER (change = 'modified') AS modified, COUNT(*) FILTER (change = 'unchanged') AS unchanged,
           COUNT(*) FILTER (change <> 'unchanged') > 0 AS changes_detected,
           COUNT(*) FILTER (change IN ('removed', 'modified')) = 0 AS backward_compatible,
           COUNT(*) FILTER (change = 'modified') > 0 AS migration_required, COUNT(*) FILTER (change = 'added') > 10 AS many_added,
           COUNT(*) FILTER (change = 'modified' AND old_type LIKE '%string%' AND new_type LIKE '%int%') > 0 AS string_to_number
    FROM ({CHANGES}) GROUP BY table_name
    """,
)
def schema_diff_summary(t: Tables) -> DataFrame:
    return sc.diff_summary(_changes(t))


WANTED = "o_orderkey string, o_custkey bigint, O_TOTALPRICE int, o_orderstatus int, channel string, retries int, weight double, checked boolean"


@plan(
    "evolve_apply",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey, CAST(trunc(o_totalprice) AS INTEGER) AS "O_TOTALPRICE",
           TRY_CAST(o_orderstatus AS INTEGER) AS o_orderstatus, '' AS channel, 0 AS retries, CAST(0 AS DOUBLE) AS weight,
           FALSE AS checked, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders
    """,
)
def evolve_apply(t: Tables) -> DataFrame:
    evolved = sc.evolve(t.orders, WANTED)
    return evolved.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@plan(
    "evolve_failures",
    """
    SELECT 'o_orderkey' AS field, 0::BIGINT AS failed FROM orders GROUP BY 1 UNION ALL
    SELECT 'O_TOTALPRICE', COUNT(*) FILTER (TRY_CAST(o_totalprice AS INTEGER) IS NULL) FROM orders UNION ALL
    SELECT 'o_orderstatus', COUNT(*) FILTER (TRY_CAST(o_orderstatus AS INTEGER) IS NULL AND o_orderstatus IS NOT NULL) FROM orders
    """,
)
def evolve_failures(t: Tables) -> DataFrame:
    return sc.failed_casts(t.orders, WANTED)


@plan(
    "evolve_mode",
    """
    SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, '' AS tier FROM customer
    """,
)
def evolve_mode(t: Tables) -> DataFrame:
    return sc.evolve(t.customer, "c_custkey bigint, c_nationkey bigint, tier string", "overwrite")


@plan(
    "register_table",
    """
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, NULL::VARCHAR AS note, o_orderstatus FROM orders
    """,
)
def register_table(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "registered")
    db = ensure_database(t.spark, f"millrace_{uuid.uuid4().hex[:12]}", f"{root}/db")
    t.orders.drop("o_orderdate").write.partitionBy("o_orderstatus").parquet(f"{root}/orders")
    table = sc.register_table(
        t.spark,
        f"{db}.orders",
        [
            ("o_orderkey", "bigint", "order key"),
            ("o_custkey", "bigint", "the customer's key"),
            ("o_totalprice", "double", ""),
            ("o_orderpriority", "string", ""),
        ],
        [("o_orderstatus", "string", "F, O or P")],
        f"{root}/orders",
    )
    sc.add_columns(t.spark, table, [("note", "string")])
    return t.spark.table(table)
