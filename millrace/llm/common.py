"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import tune

SLICE_CHARS = 1_000_000  # text handled at a time within a task; a longer text is a slice of its own


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) only, whatever else the frame holds; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of bounded text, so that long texts do not add up in memory."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for at, n in enumerate(lengths):
        if at > start and total + n > SLICE_CHARS:
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def by_slice(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a function of record batches; ``make`` builds it (and its caches) once per task.

    The function returns a batch or None. Spark deals the rows; nothing is shared between tasks.
    """

    def run(batches):
        apply = make()
        for batch in batches:
            for part in slices_of(batch):
                out = apply(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def schema_text(df: DataFrame, *extra: str) -> str:
    """The frame's schema as DDL, followed by more fields."""
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*fields, *extra])


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> str:
    """A column's name as one identifier, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def filter_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Keep the rows for which a function of (doc_id, text) batches says so.

    All columns pass through untouched, also ones whose names clash with the function's own.
    """
    types = df.schema
    text_at, id_at = df.columns.index("text"), df.columns.index("doc_id")

    def run(batches):
        decide = make()
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(id_at), batch.column(text_at)], names=["doc_id", "text"])
            done = 0
            for part in slices_of(pair):
                keep = pa.array(decide(part), type=pa.bool_())
                out = batch.slice(done, part.num_rows).filter(keep)
                done += part.num_rows
                if out.num_rows:
                    yield out

    return map_by_place(df, run, types)


def map_by_place(df: DataFrame, run: Callable, types) -> DataFrame:
    """``mapInArrow`` over all columns, whatever they are called (a dot in a name is no path there)."""
    from pyspark.sql.types import StructField, StructType

    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(types.fields)])

    def renamed(batches):
        for batch in run(pa.RecordBatch.from_arrays(b.columns, names=df_names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain.names)

    df_names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(df_names))]).mapInArrow(renamed, plain).toDF(*types.names)


def file_system(folder: str):
    """pyarrow's file system of a folder in the shared location, and the folder's path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [t if t is not None else "" for t in batch.column("text").to_pylist()]


