"""Inputs derived from the given tables, each as SQL text and as a frame.

The SQL twin of a plan embeds the text; the frame is the same text run by Spark over the
given tables, so both grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.plans.registry import Tables

# Every order changes the balance of its customer (several changes per key); every
# supplier becomes a new customer. (seq, tie) orders the changes of a key.
CUSTOMER_CHANGES = """
    SELECT c_custkey, c_name, c_nationkey, o_totalprice AS c_acctbal, c_mktsegment,
           o_orderdate AS seq, o_orderkey AS tie
    FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL
    SELECT -1 - s_suppkey, s_name, s_nationkey, s_acctbal, 'NEW', TIMESTAMP '2002-01-01 00:00:00', s_suppkey
    FROM supplier
"""

# SQL statements of several dialects and shapes, one per order.
SQL_CORPUS = """
    SELECT o_orderkey AS stmt_id,
      CASE CAST(o_orderkey % 8 AS INT)
        WHEN 0 THEN concat('SELECT * FROM sales.orders WHERE id = ', CAST(o_orderkey AS VARCHAR(20)), ';')
        WHEN 1 THEN 'select nvl(name, 0), decode(status, 1, 2) from crm.customers c join sales.orders o on c.id = o.cid'
        WHEN 2 THEN 'SELECT   *   FROM   sales.orders  ;'
        WHEN 3 THEN concat('SELECT string_agg(x) FROM app_db_eu_', CAST(o_custkey AS VARCHAR(20)), '_main WHERE a > 1 ORDER BY a;')
        WHEN 4 THEN 'WITH u AS (SELECT k, COUNT(*) AS n FROM t GROUP BY k) SELECT DISTINCT k FROM u JOIN v ON u.k = v.k;'
        WHEN 5 THEN 'SELECT CASE WHEN a = 1 THEN 2 END, ROW_NUMBER() OVER (PARTITION BY b ORDER BY c) FROM t WHERE (d = 1'
        WHEN 6 THEN 'SELECT dateadd(day, 1, d) FROM a JOIN b ON 1=1 JOIN c ON 1=1 JOIN d ON 1=1 JOIN e ON 1=1;'
        ELSE 'hello world' END AS sql
    FROM orders
"""

# SQL statements whose strings, comments, quoted names and functions hold words and parentheses that
# count for nothing; ~ stands for a quote and ^ for a line break until the last step.
SQL_TOKEN_CORPUS = """
    SELECT o_orderkey AS stmt_id, replace(replace(CASE CAST(o_orderkey % 10 AS INT)
        WHEN 0 THEN concat('SELECT a.k, ~from hidden join nothing (~ AS note FROM sales.o_', o_orderstatus, ' a JOIN crm.customers c ON a.k = c.k -- join x.y^WHERE a.k = ', CAST(o_custkey AS VARCHAR(20)))
        WHEN 1 THEN concat('WITH big AS (SELECT k FROM lake.t', CAST(o_custkey % 50 AS VARCHAR(20)), '), Small (k) AS MATERIALIZED (SELECT k FROM big) SELECT COUNT(*) FROM big, Small, "Dim ""x"" y" d WHERE d.note = ~it~~s (~')
        WHEN 2 THEN concat('SELECT EXTRACT(YEAR FROM d), TRIM(BOTH ~ ~ FROM n), SUM(v) OVER (PARTITION BY k ORDER BY d) FROM a.b.c_', CAST(o_custkey % 7 AS VARCHAR(20)), ' /* join z.z ( */ ORDER BY 1')
        WHEN 3 THEN concat('SELECT * FROM (SELECT DISTINCT k FROM s.t1, s.t2 x JOIN only t3 USING (k)) q WHERE k IS NOT DISTINCT FROM ~', CAST(o_custkey AS VARCHAR(20)), '~ ORDER BY k LIMIT 5')
        WHEN 4 THEN concat('UPDATE t SET a = $$ it~s FROM nowhere $$ WHERE (b = 1)) ; SELECT DISTINCT * FROM app_db_eu_', CAST(o_custkey AS VARCHAR(20)), '_main m')
        WHEN 5 THEN 'SELECT string_agg(x, ~,~ ORDER BY y) FROM generate_series(1, 9) g JOIN LATERAL (SELECT 1 FROM `odd name`) l ON true WHERE z = ~open string FROM t'
        WHEN 6 THEN '-- nothing from here'
        WHEN 7 THEN NULL
        WHEN 8 THEN 'select case when a = 1 then case b when 2 then 3 end end from j1 join j2 on 1=1 join j3 on 1=1 join j4 on 1=1 join j5 on 1=1 join j6 on 1=1 join j7 on 1=1 order by count(1), (select max(x) from j1)'
        ELSE concat('DELETE FROM t_', o_orderstatus, ' WHERE ts < cast(d as timestamp with time zone), k > 1 /* open comment from x')
      END, '~', chr(39)), '^', chr(10)) AS sql
    FROM orders
"""

# Files of SQL text, one per order: parts set off by dash lines, comment lines or blank
# lines, or statements that only semicolons separate.
SQL_FILES = """
    SELECT o_orderkey AS file_id, concat('sql/f_', CAST(o_orderkey AS VARCHAR(20)), '.sql') AS file_path,
      CASE o_orderpriority
        WHEN '1-URGENT' THEN concat('SELECT a FROM t WHERE k = ', CAST(o_custkey AS VARCHAR(20)), ';', chr(10), '-----', chr(10),
                                    'UPDATE t', chr(10), 'SET a = 1 WHERE (k = 2;', chr(10), '----- end', chr(10), 'select  a from t where k = ',
                                    CAST(o_custkey AS VARCHAR(20)), ';', chr(10), '---', chr(10), 'not a statement')
        WHEN '2-HIGH' THEN concat('WITH u AS (SELECT 1 FROM x) SELECT * FROM u', chr(10), '-- first', chr(10), 'DELETE FROM t WHERE k = ',
                                  CAST(o_orderkey AS VARCHAR(20)), chr(10), '-- second', chr(10), 'DROP t')
        WHEN '3-MEDIUM' THEN concat('SELECT a, b', chr(10), 'FROM t', chr(10), chr(10), chr(10), 'INSERT INTO t SELECT k FROM s;', chr(10), chr(10), chr(10), 'hello')
        WHEN '4-NOT SPECIFIED' THEN concat('Some words. SELECT a FROM t;', chr(10), 'SELECT b FROM s WHERE k = ', CAST(o_custkey AS VARCHAR(20)), '; the end')
        ELSE concat('no statement here', chr(10), 'at all ', o_orderstatus) END AS content
    FROM orders
"""

# Small job files, one per order.
CODE_CORPUS = """
    SELECT o_orderkey AS file_id, concat('src/job_', CAST(o_orderkey AS VARCHAR(20)), '.py') AS file_path,
      concat('df = spark.read.csv("s3://b/', CAST(o_orderkey % 7 AS VARCHAR(20)), '")', chr(10),
             CASE WHEN o_orderkey % 2 = 0 THEN 'x = df.groupBy("k").agg(sum("v")).collect()' ELSE 'x = df.join(other, "k")' END, chr(10),
             'def f(a):', chr(10), CASE WHEN o_orderkey % 3 = 0 THEN '    return a' ELSE '    pass' END) AS content
    FROM orders
"""

# Files with two code blocks each; those of the lowest priority do not parse.
BLOCK_CORPUS = """
    SELECT o_orderkey AS file_id, o_orderstatus AS status, substr(o_orderpriority, 1, 1) AS digit,
      concat('def load_', o_orderstatus, '(path):', chr(10), '    src_', substr(o_orderpriority, 1, 1), ' = spark.read.csv(path)', chr(10),
             '    return src_', substr(o_orderpriority, 1, 1)) AS first_block,
      concat('for k in range(', CAST(o_custkey AS VARCHAR(20)), '):', chr(10), '    print(k)') AS second_block,
      CASE WHEN o_orderpriority = '5-LOW' THEN concat(chr(10), 'else broken') ELSE '' END AS rest
    FROM orders
"""

# One file path per order, in a partitioned layout.
FILE_PATHS = """
    SELECT concat('data/year=', CAST(extract(year FROM o_orderdate) AS VARCHAR(4)), '/status=', o_orderstatus,
                  '/part-', CAST(o_orderkey AS VARCHAR(20)),
                  CASE WHEN o_orderkey % 3 = 0 THEN '.csv' ELSE '.parquet' END) AS path,
           CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1000 AS BIGINT) AS length
    FROM orders
"""


def from_sql(t: Tables, text: str, *names: str) -> DataFrame:
    """Run a derived-input text on Spark; ``names`` are the tables it mentions."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in names:
        text = text.replace(f"FROM {name}", "FROM {%s}" % name).replace(f"JOIN {name}", "JOIN {%s}" % name)
    # file timestamps have no zone
    text = text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    return t.spark.sql(text, **{name: getattr(t, name) for name in names})


def customer_changes(t: Tables) -> DataFrame:
    return from_sql(t, CUSTOMER_CHANGES, "orders", "customer", "supplier")


def sql_corpus(t: Tables) -> DataFrame:
    return from_sql(t, SQL_CORPUS, "orders")


def sql_token_corpus(t: Tables) -> DataFrame:
    return from_sql(t, SQL_TOKEN_CORPUS, "orders")


def code_corpus(t: Tables) -> DataFrame:
    return from_sql(t, CODE_CORPUS, "orders")


def file_paths(t: Tables) -> DataFrame:
    return from_sql(t, FILE_PATHS, "orders")


def sql_files(t: Tables) -> DataFrame:
    return from_sql(t, SQL_FILES, "orders")


def block_corpus(t: Tables) -> DataFrame:
    text = f"SELECT file_id, concat(first_block, chr(10), second_block, rest) AS content FROM ({BLOCK_CORPUS})"
    return from_sql(t, text, "orders")
