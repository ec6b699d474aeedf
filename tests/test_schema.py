import pytest
from pyspark.sql import functions as F

from millrace.operators import schema as sc
from tests.conftest import rows


def infer(spark, *docs):
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    return dict(rows(sc.infer_fields(df, "doc"), "field", "type"))


@pytest.mark.parametrize(
    "value,kind",
    [
        ("true", "boolean"),
        ("42", "bigint"),
        ("3.14", "double"),
        ("1e400", "double"),
        ('"text"', "string"),
        ('"2024-01-15"', "date"),
        ('"2024-01-15T10:00:00"', "timestamp"),
        ('"2024-01-15 10:00:00"', "timestamp"),
        ("[1, 2]", "array<bigint>"),
        ('["a"]', "array<string>"),
        ("[]", "array<string>"),
        ("{}", "struct<>"),
    ],
)
def test_value_types(spark, value, kind):
    got = infer(spark, '{"a": %s, "b": 1}' % value)
    assert got.get("a", "string") == kind


def test_one_record(spark):
    got = infer(
        spark,
        '{"customer_id": 1, "customer_name": "n", "order_amount": 1.5, "order_date": "2023-01-01", "is_premium": true, "year": "2023"}',
    )
    assert got == {
        "customer_id": "bigint", "customer_name": "string", "order_amount": "double",
        "order_date": "date", "is_premium": "boolean", "year": "string",
    }


def test_mixed_types_become_string_and_nulls_do_not_vote(spark):
    got = infer(spark, '{"a": 1, "b": 1, "c": null}', '{"a": "x", "b": null, "c": null}', "broken", '{"b": 2}')
    assert got == {"a": "string", "b": "bigint", "c": "string"}


def test_partition_candidates_by_cardinality(spark):
    df = spark.range(100).select(
        F.col("id").alias("user_id"),
        F.when(F.col("id") < 60, "us").otherwise("eu").alias("zone"),
        F.lit("x").alias("load_month"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 40).alias("near"),  # 20 values: exactly the limit
    )
    got = {r.field: (r.by_name, r.by_values) for r in sc.partition_candidates(df).collect()}
    assert got == {
        "user_id": (False, False), "zone": (False, True), "load_month": (True, True), "near": (False, False),
    }
    few = sc.partition_candidates(df.limit(10))
    assert not few.where("by_values").count()  # ten rows or fewer prove nothing


def snapshot(spark, **columns):
    return spark.createDataFrame([("t", c, k) for c, k in columns.items()], "table_name string, column_name string, type string")


def test_added_columns_are_compatible(spark):
    old = snapshot(spark, id="bigint", name="string")
    new = snapshot(spark, id="bigint", NAME="string", email="string", created_at="timestamp")
    got = sc.diff_summary(sc.diff_columns(old, new)).first()
    assert (got.added, got.removed, got.modified, got.unchanged) == (2, 0, 0, 2)
    assert got.changes_detected and got.backward_compatible and not got.migration_required
    strict = sc.diff_summary(sc.diff_columns(old, new, case_sensitive=True)).first()
    assert (strict.added, strict.removed) == (3, 1)


def test_modified_columns_need_a_migration(spark):
    got = sc.diff_summary(
        sc.diff_columns(snapshot(spark, id="string", amount="float"), snapshot(spark, id="bigint", amount="double"))
    ).first()
    assert got.modified == 2 and got.migration_required and not got.backward_compatible and got.string_to_number


def test_evolve_modes(spark):
    df = spark.createDataFrame([("1", 2.5, "x"), ("z", 3.5, "y")], "id string, amount double, extra string")
    wanted = "id bigint, AMOUNT double, tags array<string>, since date, flag boolean"
    merged = sc.evolve(df, wanted)
    assert merged.columns == ["id", "AMOUNT", "tags", "since", "flag", "extra"]
    assert [tuple(r) for r in merged.orderBy("extra").collect()] == [
        (1, 2.5, [], None, False, "x"), (None, 3.5, [], None, False, "y"),
    ]
    assert sc.evolve(df, wanted, "overwrite").columns == ["id", "AMOUNT", "tags", "since", "flag"]
    with pytest.raises(sc.SchemaMismatch):
        sc.evolve(df, wanted, "fail")
    assert sc.evolve(df, df.schema, "fail") is df
    assert rows(sc.failed_casts(df, wanted)) == [("id", 1)]
    with pytest.raises(ValueError):
        sc.evolve(df, wanted, "other")


def test_nested_default_types(spark):
    got = spark.range(1).select(sc.default_of("string").alias("s"), sc.default_of("int").alias("i"), sc.default_of("date").alias("d")).first()
    assert tuple(got) == ("", 0, None)
