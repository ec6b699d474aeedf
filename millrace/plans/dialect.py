"""Dialect functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.functions import dialect as d
from millrace.operators.joins import outer_join
from millrace.plans.registry import Tables, plan

LEFT = """customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 400000)
          ON c_custkey = o_custkey"""


def _left(t: Tables) -> DataFrame:
    big = t.orders.where(F.col("o_totalprice") > 400000).select(
        "o_custkey", "o_orderkey", "o_orderpriority"
    )
    return outer_join(t.customer, big, [("c_custkey", "o_custkey")], "left")


@plan(
    "fn_coalesce",
    f"""
    SELECT c_custkey, o_orderkey, COALESCE(o_orderkey, -c_custkey, 0) AS a,
           COALESCE(o_orderpriority, 'none') AS b, COALESCE(o_orderpriority, c_mktsegment) AS c FROM {LEFT}
    """,
)
def fn_coalesce(t: Tables) -> DataFrame:
    return _left(t).select(
        "c_custkey",
        "o_orderkey",
        d.coalesce("o_orderkey", -F.col("c_custkey"), F.lit(0)).alias("a"),
        d.call("oracle", "NVL", "o_orderpriority", F.lit("none")).alias("b"),
        d.call("redshift", "ISNULL", "o_orderpriority", "c_mktsegment").alias("c"),
    )


@plan(
    "fn_nvl2",
    f"""
    SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NOT NULL THEN 'has' ELSE 'none' END AS state FROM {LEFT}
    """,
)
def fn_nvl2(t: Tables) -> DataFrame:
    return _left(t).select("c_custkey", "o_orderkey", d.nvl2("o_orderkey", "has", "none").alias("state"))


@plan(
    "fn_decode",
    f"""
    SELECT c_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority = '2-HIGH' THEN 2
           WHEN o_orderpriority IS NULL THEN -1 ELSE 9 END AS code FROM {LEFT}
    """,
)
def fn_decode(t: Tables) -> DataFrame:
    code = d.decode("o_orderpriority", "1-URGENT", 1, "2-HIGH", 2, None, -1, 9)
    return _left(t).select("c_custkey", "o_orderkey", code.alias("code"))


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
LINE_COLUMNS = LINE.split(", ")


@plan("fn_nullif", f"SELECT {LINE}, NULLIF(l_returnflag, 'N') AS flag, NULLIF(l_discount, 0) AS discount FROM lineitem")
def fn_nullif(t: Tables) -> DataFrame:
    return t.lineitem.select(
        *LINE_COLUMNS, d.nullif("l_returnflag", "N").alias("flag"), d.nullif("l_discount", 0.0).alias("discount")
    )


@plan(
    "fn_greatest_least",
    f"""
    SELECT {LINE}, GREATEST(l_discount, l_tax) AS high, LEAST(l_discount, l_tax) AS low,
           GREATEST(NULLIF(l_linenumber, 1), 3) AS skipped FROM lineitem
    """,
)
def fn_greatest_least(t: Tables) -> DataFrame:
    return t.lineitem.select(
        *LINE_COLUMNS,
        d.greatest("l_discount", "l_tax").alias("high"),
        d.least("l_discount", "l_tax").alias("low"),
        d.greatest(d.nullif("l_linenumber", 1), F.lit(3)).alias("skipped"),
    )


@plan("fn_substr", "SELECT p_partkey, SUBSTR(p_name, 2, 4) AS part, SUBSTR(p_brand, 6) AS tail FROM part")
def fn_substr(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", d.substr("p_name", 2, 4).alias("part"), d.substr("p_brand", 6).alias("tail")
    )


@plan("fn_len", "SELECT p_partkey, CAST(length(rtrim(p_name || '   ')) AS INTEGER) AS n FROM part")
def fn_len(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", d.len_(F.concat("p_name", F.lit("   "))).alias("n"))


@plan(
    "fn_charindex",
    """
    SELECT p_partkey, CAST(instr(p_name, 'r') AS INTEGER) AS at,
           CAST(CASE WHEN instr(substr(p_name, 4), 'i') = 0 THEN 0 ELSE instr(substr(p_name, 4), 'i') + 3 END AS INTEGER) AS later
    FROM part
    """,
)
def fn_charindex(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        d.call("redshift", "CHARINDEX", "r", "p_name").alias("at"),
        d.charindex("i", "p_name", 4).alias("later"),
    )


@plan("fn_stuff", "SELECT p_partkey, substr(p_name, 1, 1) || '##' || substr(p_name, 4) AS changed FROM part")
def fn_stuff(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", d.stuff("p_name", 2, 2, "##").alias("changed"))


@plan(
    "fn_regexp_replace",
    """
    SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS every, regexp_replace(p_name, '[aeiou]', '*') AS once,
           regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\\2 \\1') AS swapped FROM part
    """,
)
def fn_regexp_replace(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        d.regexp_replace("p_name", "[aeiou]", "*", "g").alias("every"),
        d.regexp_replace("p_name", "[aeiou]", "*").alias("once"),
        d.regexp_replace("p_name", "([a-z]+) ([a-z]+)", r"\2 \1").alias("swapped"),
    )


@plan("fn_lpad", "SELECT c_custkey, LPAD(CAST(c_custkey AS VARCHAR), 12, '0') AS code FROM customer")
def fn_lpad(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", d.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("code"))


@plan("fn_conv", "SELECT c_custkey, upper(to_base(c_custkey, 16)) AS hex, to_base(c_custkey, 2) AS bits FROM customer")
def fn_conv(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", d.conv("c_custkey", 10, 16).alias("hex"), d.conv("c_custkey", 10, 2).alias("bits")
    )


@plan(
    "fn_round",
    f"""
    SELECT {LINE}, CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,6)), 1) AS DOUBLE) AS tenth,
           CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,6)), 0) AS DOUBLE) AS whole FROM lineitem
    """,
)
def fn_round(t: Tables) -> DataFrame:
    return t.lineitem.select(
        *LINE_COLUMNS,
        d.round_("l_extendedprice", 1).cast("double").alias("tenth"),
        d.round_("l_extendedprice").cast("double").alias("whole"),
    )


@plan(
    "fn_extract",
    """
    SELECT event_id, CAST(extract(year FROM ts) AS INTEGER) AS y, CAST(extract(month FROM ts) AS INTEGER) AS m,
           CAST(extract(day FROM ts) AS INTEGER) AS d, CAST(extract(hour FROM ts) AS INTEGER) AS h FROM events
    """,
)
def fn_extract(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        d.extract("YEAR", "ts").alias("y"),
        d.extract("MONTH", "ts").alias("m"),
        d.call("redshift", "DATEPART", "day", "ts").alias("d"),
        d.extract("HOUR", "ts").alias("h"),
    )


def _stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@plan(
    "fn_date_trunc",
    """
    SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour,
           strftime(CAST(date_trunc('week', ts) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS week FROM events
    """,
)
def fn_date_trunc(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        _stamp(d.date_trunc("hour", "ts")).alias("hour"),
        _stamp(d.date_trunc("week", "ts")).alias("week"),
    )


@plan(
    "fn_trunc",
    """
    SELECT o_orderkey, strftime(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS month,
           strftime(CAST(date_trunc('day', o_orderdate) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS day,
           CAST(trunc(o_totalprice) AS DOUBLE) AS whole, CAST(trunc(-o_totalprice) AS DOUBLE) AS negative FROM orders
    """,
)
def fn_trunc(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        _stamp(d.call("oracle", "TRUNC", "o_orderdate", "MONTH")).alias("month"),
        _stamp(d.trunc_date("o_orderdate")).alias("day"),
        d.trunc_number("o_totalprice").cast("double").alias("whole"),
        d.trunc_number(-F.col("o_totalprice")).cast("double").alias("negative"),
    )


@plan(
    "fn_to_char",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%d/%m/%y') AS short,
           format('{:,.2f}', value) AS amount FROM events
    """,
)
def fn_to_char(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        d.to_char_date("ts", "YYYY-MM-DD HH24:MI:SS").alias("stamp"),
        d.to_char_date("ts", "DD/MM/YY").alias("short"),
        d.to_char_number("value", "999,999,990.00").alias("amount"),
    )


@plan(
    "fn_to_date",
    """
    SELECT o_orderkey, strftime(strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y'), '%Y-%m-%d') AS day,
           strftime(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d'), '%Y-%m-%d %H:%M:%S') AS stamp FROM orders
    """,
)
def fn_to_date(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        d.to_date(d.to_char_date("o_orderdate", "DD.MM.YYYY"), "DD.MM.YYYY").cast("string").alias("day"),
        _stamp(d.to_timestamp(d.to_char_date("o_orderdate", "YYYYMMDD"), "YYYYMMDD")).alias("stamp"),
    )


@plan("fn_now", "SELECT event_id, ts <= now()::TIMESTAMP AS past, '2024-01-31' AS today FROM events")
def fn_now(t: Tables) -> DataFrame:
    as_of = F.lit("2024-01-31 08:00:00").cast("timestamp_ntz")
    return t.events.select(
        "event_id",
        (F.col("ts") <= d.call("oracle", "SYSDATE")).alias("past"),
        d.today(as_of).cast("string").alias("today"),
    )


@plan(
    "fn_dateadd",
    """
    SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS month, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS days,
           strftime(o_orderdate - INTERVAL 2 YEAR, '%Y-%m-%d') AS years, strftime(o_orderdate + INTERVAL 3 WEEK, '%Y-%m-%d') AS weeks,
           strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H') AS hours, strftime(o_orderdate + INTERVAL 6 MONTH, '%Y-%m-%d') AS quarters
    FROM orders
    """,
)
def fn_dateadd(t: Tables) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.orders.select(
        "o_orderkey",
        day(d.dateadd("month", 1, "o_orderdate")).alias("month"),
        day(d.call("redshift", "DATEADD", "day", 10, "o_orderdate")).alias("days"),
        day(d.dateadd("year", -2, "o_orderdate")).alias("years"),
        day(d.dateadd("weeks", 3, "o_orderdate")).alias("weeks"),
        F.date_format(d.dateadd("hour", 36, "o_orderdate"), "yyyy-MM-dd HH").alias("hours"),
        day(d.dateadd("quarter", 2, "o_orderdate")).alias("quarters"),
    )


@plan(
    "fn_datediff",
    f"""
    SELECT {LINE}, date_diff('year', o_orderdate, l_shipdate) AS years, date_diff('quarter', o_orderdate, l_shipdate) AS quarters,
           date_diff('month', o_orderdate, l_shipdate) AS months, CAST(date_diff('day', date_trunc('week', o_orderdate), date_trunc('week', l_shipdate)) / 7 AS BIGINT) AS weeks,
           date_diff('day', o_orderdate, l_shipdate) AS days, date_diff('hour', o_orderdate, l_shipdate) AS hours
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def fn_datediff(t: Tables) -> DataFrame:
    dates = t.orders.select("o_orderkey", "o_orderdate")
    pairs = t.lineitem.join(dates, F.col("l_orderkey") == F.col("o_orderkey"))
    diffs = [
        d.datediff(unit, "o_orderdate", "l_shipdate").alias(f"{unit}s")
        for unit in ("year", "quarter", "month", "week", "day", "hour")
    ]
    return pairs.select(*LINE_COLUMNS, *diffs)


@plan(
    "fn_datediff_fine",
    """
    SELECT event_id, date_diff('minute', TIMESTAMP '2024-01-01 00:00:30', ts) AS minutes,
           date_diff('second', TIMESTAMP '2024-01-01 00:00:30', ts) AS seconds FROM events
    """,
)
def fn_datediff_fine(t: Tables) -> DataFrame:
    start = F.lit("2024-01-01 00:00:30").cast("timestamp_ntz")
    return t.events.select(
        "event_id",
        d.datediff("minute", start, "ts").alias("minutes"),
        d.datediff("second", start, "ts").alias("seconds"),
    )


@plan(
    "fn_convert",
    f"SELECT {LINE}, CAST(l_quantity AS INTEGER) AS q, CAST(l_orderkey AS VARCHAR) AS code FROM lineitem",
)
def fn_convert(t: Tables) -> DataFrame:
    return t.lineitem.select(
        *LINE_COLUMNS,
        d.call("redshift", "CONVERT", "integer", "l_quantity").alias("q"),
        d.convert("varchar(20)", "l_orderkey").alias("code"),
    )
