import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import dialect as d
from millrace.operators.expressions import spark_type


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "unit,start,end,want",
    [
        ("month", "2024-01-31", "2024-02-01", 1),
        ("year", "2023-12-31", "2024-01-01", 1),
        ("quarter", "2024-03-31", "2024-04-01", 1),
        ("week", "2024-01-07", "2024-01-08", 1),
        ("week", "2024-01-08", "2024-01-14", 0),
        ("day", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
        ("hour", "2024-01-01 10:59:00", "2024-01-01 11:01:00", 1),
        ("minute", "2024-01-01 10:00:59", "2024-01-01 10:01:00", 1),
        ("second", "2024-01-01 10:00:59", "2024-01-01 10:00:10", -49),
        ("days", "2024-03-01", "2024-02-28", -2),
    ],
)
def test_datediff_counts_boundaries(spark, unit, start, end, want):
    assert value(spark, d.datediff(unit, ts(start), ts(end))) == want


@pytest.mark.parametrize(
    "unit,n,want",
    [("month", 1, "2024-02-29"), ("year", 1, "2025-01-31"), ("quarter", 1, "2024-04-30"), ("week", -1, "2024-01-24")],
)
def test_dateadd_clamps_to_the_month_end(spark, unit, n, want):
    assert value(spark, d.dateadd(unit, n, ts("2024-01-31"))) == dt.datetime.fromisoformat(want)


def test_unknown_unit():
    with pytest.raises(ValueError):
        d.dateadd("fortnight", 1, "x")


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("YYYY-MM-DD HH24:MI:SS", "yyyy-MM-dd HH:mm:ss"),
        ("DD-MON-YY", "dd-MMM-yy"),
        ('YYYY"T"HH24', "yyyy'T'HH"),
        ("Month DD", "MMMM dd"),
    ],
)
def test_date_pattern(pattern, want):
    assert d.date_pattern(pattern) == want


def test_regexp_replace(spark):
    x = F.lit("a1b22c1")
    assert value(spark, d.regexp_replace(x, r"\d+", "#")) == "a#b22c1"
    assert value(spark, d.regexp_replace(x, r"\d+", "#", "g")) == "a#b#c#"
    assert value(spark, d.regexp_replace(x, r"([a-z])(\d)", r"\2\1")) == "1ab22c1"
    assert value(spark, d.regexp_replace(x, "B", "5", "i")) == "a1522c1"
    assert value(spark, d.regexp_replace(x, "b", "$")) == "a1$22c1"
    assert value(spark, d.regexp_replace(F.lit("x\ny"), "y", "z")) == "x\nz"


def test_decode_matches_null(spark):
    null = F.lit(None).cast("string")
    assert value(spark, d.decode(null, "a", 1, None, 2, 3)) == 2
    assert value(spark, d.decode(F.lit("z"), "a", 1)) is None


def test_text_helpers(spark):
    assert value(spark, d.len_(F.lit("ab  "))) == 2
    assert value(spark, d.charindex("b", F.lit("abcb"), 3)) == 4
    assert value(spark, d.charindex("x", F.lit("abc"))) == 0
    assert value(spark, d.stuff(F.lit("abcdef"), 2, 3, "XY")) == "aXYef"
    assert value(spark, d.conv(F.lit("255"), 10, 16)) == "FF"


def test_numbers(spark):
    assert float(value(spark, d.trunc_number(F.lit(-2.7)))) == -2.0
    assert float(value(spark, d.trunc_number(F.lit(2.789), 1))) == 2.7
    assert float(value(spark, d.round_(F.lit(2.5)))) == 3.0
    assert value(spark, d.to_char_number(F.lit(1234.5), "999,990.00")) == "1,234.50"


def test_call(spark):
    assert value(spark, d.call("oracle", "NVL", F.lit(None).cast("int"), F.lit(4))) == 4
    assert value(spark, d.call("spark", "upper", F.lit("a"))) == "A"  # unknown: passed on
    assert value(spark, d.call("no such dialect", "COALESCE", F.lit(1))) == 1
    as_of = ts("2024-01-01")
    assert value(spark, d.call("redshift", "GETDATE", as_of)) == dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "name,want",
    [("NUMERIC(12,4)", "decimal(12,4)"), ("bigint", "bigint"), ("VARCHAR(20)", "string"), ("integer", "int"), ("interval", "interval")],
)
def test_type_names(name, want):
    assert spark_type(name) == want
