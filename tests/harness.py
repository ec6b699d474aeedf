"""Run plans on Spark and their SQL twins on DuckDB, and compare the rows.

    python -m tests.harness /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from millrace.session import clear_scratch

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def type_family(name: str) -> str:
    name = name.lower()
    if name.startswith("decimal"):
        return "decimal"
    return {
        "tinyint": "int", "smallint": "int", "integer": "int", "int": "int",
        "bigint": "bigint", "varchar": "string", "string": "string", "double": "double",
        "float": "float", "boolean": "boolean", "date": "date",
        "timestamp_ntz": "timestamp", "timestamp": "timestamp",
    }.get(name, name)


def compare(spark, con, build, sql, folder):
    """None if equal, else a message."""
    df = build(spark, folder)
    got_names, got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_names, want = rows_of(names, rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    duck_types = dict(zip(names, [str(t) for t in con.sql(sql).types]))
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = [
        f"{n}: {spark_types[n]} / {duck_types[n]}"
        for n in got_names
        if type_family(spark_types[n]) != type_family(duck_types[n])
    ]
    if odd:
        return "types " + "; ".join(odd)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference in {got_names}:\n  spark {a}\n  sql   {b}"
    return None if got else "EMPTY"


def main(argv):
    folder, parts = argv[0], argv[1:]
    import __spark_entry__ as entry

    spark, con = session(), duck(folder)
    oracles, bad = entry.oracle_sql(), []
    for name, build in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                message = compare(spark, con, build, oracles[name], folder)
            else:
                message = None if build(spark, folder).count() else "EMPTY"
        except Exception as err:  # report and go on with the next plan
            message = f"{type(err).__name__}: {str(err)[:1500]}"
        took = time.time() - start
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if message is None else 'FAIL'} {kind} {took:6.2f}s {name}", flush=True)
        if message:
            bad.append(name)
            print("     ", message, flush=True)
    clear_scratch(spark)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
