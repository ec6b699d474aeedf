"""Findings of the last review, each with the input that showed it."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from millrace.functions import dialect as d
from millrace.operators import duplicates, history, incremental as inc
from millrace.sources import files
from tests.conftest import rows


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_csv_gives_back_what_was_written(spark, tmp_path):
    texts = ["a\nb", "", None, "  blank  ", 'say "x"', "back\\slash", "c:\\", "x,y", "\r\n", "'", '"']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    path = files.write_table(df.coalesce(1), str(tmp_path / "c"), "csv")
    assert sorted(map(tuple, files.read_table(spark, path, "csv", schema=df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_text_files_have_no_size_limit(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 30 + "\ny\n")
    [row] = files.scan_text_corpus(spark, str(tmp_path)).collect()
    assert row.content == "x" * 30 + "\ny\n" and row.error is None
    assert rows(files.scan_text_lines(spark, str(tmp_path)), "line") == [("x" * 30,), ("y",)]


def test_regexp_replace_with_a_back_reference_in_the_pattern(spark):
    assert value(spark, d.regexp_replace(F.lit("xaab"), r"(a)\1", r"<\1>")) == "x<a>b"


def test_round_trunc_and_to_char_of_numbers(spark):
    assert value(spark, d.round_(F.lit(Decimal("1.123456789")), 8)) == Decimal("1.12345679")
    assert float(value(spark, d.round_(F.lit(1e13) + 0.25, 1))) == 1e13 + 0.3
    assert value(spark, d.to_char_number(F.lit(Decimal("1.239")), "0.000")) == "1.239"
    assert value(spark, d.call("oracle", "TO_CHAR", F.lit(Decimal("1234.5")), "9,990.00")) == "1,234.50"
    assert value(spark, d.call("oracle", "TO_CHAR", F.lit(dt.datetime(2024, 1, 2)), "YYYY-MM-DD")) == "2024-01-02"
    assert value(spark, d.call("oracle", "TRUNC", F.lit(Decimal("-1.239")), 2)) == Decimal("-1.23")
    assert value(spark, d.call("oracle", "TRUNC", F.lit(Decimal("1299.5")), -2)) == Decimal("1200")


def test_statement_keys_ignore_outer_white_space_of_all_kinds(spark):
    one, two = (value(spark, history.statement_key(F.lit(s))) for s in ("SELECT 1", "\tselect 1\r\n"))
    assert one == two


def test_watermark_over_numbers_and_before_1970(spark, tmp_path):
    marks = inc.MarkStore(spark, str(tmp_path / "m"))
    numbers = spark.createDataFrame([(1, -5), (2, 7)], "id int, n bigint")
    assert inc.load_watermark(numbers, str(tmp_path / "n"), "n", "n", marks, ["id"])["rows"] == 2
    assert inc.load_watermark(numbers, str(tmp_path / "n"), "n", "n", marks, ["id"])["rows"] == 0
    old = spark.createDataFrame([(1, dt.datetime(1950, 1, 1)), (2, dt.datetime(2000, 1, 1))], "id int, ts timestamp_ntz")
    assert inc.load_watermark(old, str(tmp_path / "t"), "ts", "t", marks, ["id"])["rows"] == 2


def test_long_texts_that_differ_in_the_first_letter_are_similar(spark):
    line = " ".join(f"word{i % 7}" for i in range(60))
    pair = spark.createDataFrame([("x" + line, "y" + line)], "a string, b string")
    assert pair.select(duplicates.text_ratio(F.col("a"), F.col("b")).alias("r")).first().r > 0.99
