import pytest
from pyspark.sql import functions as F

from millrace.operators import etl, layout as ly
from millrace.session import path_exists, scratch_path, shared_root, shuffle_partitions, size_shuffles, spread
from millrace.sources import files
from tests.conftest import plan_text, rows


@pytest.mark.parametrize("fmt", files.EXTRA_FORMATS)
def test_missing_format_is_named(spark, tables, fmt):
    with pytest.raises(files.MissingFormat, match=fmt):
        files.read_table(spark, "/nowhere", fmt)
    with pytest.raises(files.MissingFormat, match=fmt):
        files.write_table(tables.region, scratch_path(spark, "x"), fmt)


def test_unknown_format(spark, tables):
    with pytest.raises(ValueError):
        files.read_table(spark, "/x", "xls")
    with pytest.raises(ValueError):
        files.write_table(tables.region, "/x", "xls")


def test_json_drops_malformed_and_reads_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    got = files.read_table(spark, str(tmp_path), "json", "a int", multiLine=True)
    assert rows(got) == [(1,), (2,)]
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "b.json").write_text('{"a": 1}\nbroken\n{"a": 3}\n')
    assert rows(files.read_table(spark, str(lines), "json", "a int").select("a")) == [(1,), (3,)]


def test_csv_infers_without_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"two\nlines"\n2,b\n')
    got = files.read_table(spark, str(tmp_path), "csv", multiLine=True)
    assert dict(got.dtypes)["id"] == "int" and got.count() == 2


def test_text_corpus_reports_large_files_and_skips_bad_bytes(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.sql").write_bytes(b"SELECT \xff1\xef\xbb\xbf")
    (tmp_path / "b.txt").write_text("x" * 50)
    (tmp_path / "c.py").write_text("no")
    got = {r.file_path.rsplit("/", 1)[1]: r for r in files.scan_text_corpus(spark, str(tmp_path), max_bytes=20).collect()}
    assert set(got) == {"a.sql", "b.txt"}
    assert got["a.sql"].content == "SELECT 1" and got["a.sql"].error is None
    assert got["b.txt"].content is None and "20 bytes" in got["b.txt"].error


def test_pushdown_and_pruning_reach_the_scan(spark, tables):
    df = tables.lineitem.where("l_quantity > 10").select("l_orderkey")
    text = plan_text(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    path = files.write_table(tables.orders, scratch_path(spark, "p"), partition_by=["o_orderstatus"])
    text = plan_text(files.read_table(spark, path).where("o_orderstatus = 'F'"))
    assert "PartitionFilters: [isnotnull(o_orderstatus" in text


def test_bucketed_tables_join_without_a_shuffle(spark, tables):
    db = files.ensure_database(spark, "buckets_db", scratch_path(spark, "db"))
    orders = files.save_table(tables.orders, f"{db}.o", bucket_by=(4, ["o_orderkey"]))
    lines = files.save_table(tables.lineitem, f"{db}.l", bucket_by=(4, ["l_orderkey"]))
    joined = spark.table(lines).join(spark.table(orders).hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_etl_counts_what_it_wrote(spark, tables):
    out = scratch_path(spark, "etl")
    done = etl.run_etl(spark, tables.path("orders"), out, "SELECT * FROM {source_table} WHERE o_orderstatus = 'F'")
    assert done.metrics["rows_written"] == spark.read.parquet(out).count() > 0


def test_scratch_paths_are_below_the_shared_folder(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(shared_root(spark)) and not path_exists(spark, a)


def test_spread_leaves_large_frames_alone(spark, tables, monkeypatch):
    assert spread(tables.orders).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr("millrace.session.SMALL_SHARE", 0)
    assert spread(tables.orders).rdd.getNumPartitions() == tables.orders.rdd.getNumPartitions()


def test_shuffles_are_sized_by_input_and_never_lowered(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = shuffle_partitions(spark)
    size_shuffles(spark, 1)
    assert shuffle_partitions(spark) == before
    size_shuffles(spark, 100 * 10**12)
    assert shuffle_partitions(spark) == -(-100 * 10**12 // (512 * 1024 * 1024))  # no cap
    spark.conf.unset(key)
    assert shuffle_partitions(spark) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "yarn", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session())


# --- layout ------------------------------------------------------------------------


def test_listing_examples(spark):
    listing = spark.createDataFrame(
        [("s3/data/year=2023/month=01/a.parquet", 1 << 20), ("s3/data/year=2023/month=02/b.parquet", 2 << 20)],
        "path string, length bigint",
    )
    assert {r.key for r in ly.partition_keys(listing).collect()} == {"year", "month"}
    assert {r.f for r in listing.select(ly.format_of("path").alias("f")).collect()} == {"parquet"}
    assert listing.agg(F.sum("length") / ly.MB).first()[0] == 3.0


@pytest.mark.parametrize(
    "path,fmt",
    [("a/b.PARQUET", "parquet"), ("x.csv.gz", "csv"), ("x.json", "json"), ("x.orc", "orc"), ("x.avro", "avro"),
     ("t/_delta_log/0.x", "delta"), ("x.bin", "unknown")],
)
def test_format_of(spark, path, fmt):
    assert spark.range(1).select(ly.format_of(F.lit(path))).first()[0] == fmt


def test_location_summary_sees_delta(spark, tmp_path):
    (tmp_path / "_delta_log").mkdir()
    (tmp_path / "_delta_log" / "0.json").write_text("{}")
    (tmp_path / "part-0.parquet").write_bytes(b"1234")
    row = ly.location_summary(spark, str(tmp_path)).first()
    assert row.is_delta and row.n_files == 1 and row.formats == ["parquet"]


@pytest.mark.parametrize("strategy,keys", [("coalesce", None), ("repartition", None), ("repartition", ["o_orderstatus"])])
def test_compaction_keeps_rows_and_cuts_files(spark, tables, strategy, keys):
    source, target = scratch_path(spark, "many"), scratch_path(spark, "few")
    tables.orders.repartition(30).write.parquet(source)
    done = ly.compact(spark, source, target, strategy, partition_by=keys)
    n = lambda p: ly.file_inventory(spark, p, "*.parquet").count()
    assert done["rows"] == tables.orders.count() and n(source) == 30 and n(target) <= 3
    columns = sorted(tables.orders.columns)
    assert spark.read.parquet(target).select(*columns).exceptAll(tables.orders.select(*columns)).isEmpty()


def test_compaction_rejects_unknown_strategy(spark, tables):
    with pytest.raises(ValueError):
        ly.compact(spark, tables.path("orders"), scratch_path(spark, "x"), "zip")
