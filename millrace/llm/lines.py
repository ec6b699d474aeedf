"""Substring dedup by line or paragraph hashing.

Units are normalised and hashed; equal digests are grouped over the whole corpus, the earliest
occurrence by (doc_id, offset) stays, and all others are removed. A unit begins at every line (or
paragraph between blank lines) that is not blank and takes in the ones behind it until it has
``min_words`` words, so a long line is a unit of its own and short ones count as parts of a repeated
run of lines: single short lines stand in many texts that share nothing else. With ``min_words`` of 1
every line is judged alone. With ``passage_words`` a passage is found inside longer or edited lines too:
a second kind of unit begins at every clause (a part of a line that ends with a mark before white space)
and takes in the clauses behind it until it has so many words. Units are compared with those of their kind.
What is removed is told as spans: units that overlap are one span. A removed line or clause always stays
where it came first, since each occurrence leads to an earlier one. Offsets are code points of the
original text, end exclusive.

Defined cases. Null text: empty, no units. The end of a text that has fewer than ``min_words`` words
begins no unit. A null doc_id ranks before all others. Rows that repeat a doc_id and text are copies: of
their units, one row's stay, all of the same row. Empty table: no rows. Other columns are not read;
``remove_repeats`` passes them through.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import by_slice, free_name, quoted
from millrace.session import materialize

MIN_WORDS = 15
PASSAGE_WORDS = 40  # most passages of over 50 words hold a run of so many, shorter ones do not count
_UNITS = {
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"(?:[^\n]+\n?)+"),
    "clause": re.compile(r"(?=\S)[^\n.,;:!?]*(?:[.,;:!?]++(?!\s)[^\n.,;:!?]+)*[.,;:!?]*"),
}
_DIGITS = re.compile(r"\d+")


def normalise(unit: str) -> list[str]:
    """Words in lower case and composed form, runs of digits as one zero."""
    return _DIGITS.sub("0", (unit if unit.isascii() else unicodedata.normalize("NFC", unit)).lower()).split()


def units_of(text: str, unit: str = "line", min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(digest, start, end) of the units, in order; the digests of clauses are others than those of lines."""
    kind = b"clause" if unit == "clause" else b""
    lines = [(words, m.start(), m.end()) for m in _UNITS[unit].finditer(text) if (words := normalise(m.group()))]
    joined = [" ".join(words).encode("utf-8", "surrogatepass") for words, _, _ in lines]
    out, last, held = [], 0, 0  # the run holds the lines up to ``last``, ``held`` words
    for first, (words, start, _) in enumerate(lines):
        while last < len(lines) and held < min_words:
            held += len(lines[last][0])
            last += 1
        if held < min_words:
            break
        out.append((hashlib.blake2b(b"\n".join(joined[first:last]), digest_size=16, person=kind).digest(), start, lines[last - 1][2]))
        held -= len(words)
    return out


UNITS = "n_units bigint, n_passages bigint, n_chars bigint, units array<struct<digest: binary, start: bigint, end: bigint, passage: boolean>>"


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """The rows with a number, written once so that the number stays."""
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")


def _with_units(rows: DataFrame, unit: str, min_words: int, passage_words: int | None) -> DataFrame:
    """(row, doc_id, n_units, n_passages, n_chars, units) from (row, doc_id, text)."""

    def make():
        def apply(batch):
            texts = batch.column("text").to_pylist()
            units = [units_of(t, unit, min_words) for t in texts]
            passages = [units_of(t, "clause", passage_words) if passage_words else [] for t in texts]
            counts, more = [len(u) for u in units], [len(p) for p in passages]
            digests, starts, ends = zip(*chain(*chain.from_iterable(zip(units, passages, strict=True))), strict=True) if any(counts + more) else ((), (), ())
            kinds = np.tile([False, True], len(texts)).repeat(np.ravel(np.column_stack([counts, more])))
            flat = pa.StructArray.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(kinds)],
                names=["digest", "start", "end", "passage"],
            )
            bounds = np.cumsum([0, *map(sum, zip(counts, more, strict=True))])
            columns = [
                batch.column("row"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(more, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_units", "n_passages", "n_chars", "units"])

        return apply

    return by_slice(rows, make, "row bigint, doc_id bigint, " + UNITS)


def repeats(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, row: str | None = None, passage_words: int | None = None) -> DataFrame:
    """(row, doc_id, n_units, n_chars, n_repeated, removed): spans to remove, in order; one row per document.

    ``n_repeated`` counts the units that stand elsewhere too, here first or not. With ``passage_words`` the runs
    of clauses are counted beside them: ``n_passages`` and ``n_repeated_passages`` come last. ``row`` names a column that
    numbers the rows; without it they are numbered here. The digests of a task are aggregated before the
    shuffle; the repeated ones, one row each, are written before units are joined with them, so that a unit
    in a third of all documents is split by adaptive execution. Texts are not moved.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), number.alias("row"))
    found = materialize(_with_units(rows, unit, min_words, passage_words), "units")
    each = found.select("row", "doc_id", F.explode("units").alias("u")).select(
        F.col("u.digest").alias("digest"), F.struct("doc_id", "row", F.col("u.start").alias("start"), F.col("u.end").alias("end")).alias("at"),
        F.col("u.passage").alias("passage"),
    )
    first = each.groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    first = materialize(first.select("digest", "first"), "repeated-digests")
    later = ~F.col("at").eqNullSafe(F.col("first"))
    again = each.join(first, "digest").select(
        F.col("at.row").alias("row"), "passage", F.when(later, F.col("at.start")).alias("start"), F.when(later, F.col("at.end")).alias("end")
    )
    # a maximal span begins where none before it reaches; units that stay have no place and come first
    by_start = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begins = again.withColumn("begins", F.when(F.col("start") >= F.coalesce(reach, F.lit(0)), 1).otherwise(0))
    spans = begins.withColumn("span", F.sum("begins").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    whole = spans.groupBy("row", "span").agg(
        F.count_if(~F.col("passage")).alias("n"), F.count_if("passage").alias("m"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    listed = F.collect_list(F.when(F.col("span") > 0, F.struct("start", "end")))
    spans = whole.groupBy("row").agg(F.sum("n").alias("n_repeated"), F.sum("m").alias("n_repeated_passages"), F.sort_array(listed).alias("removed"))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    zero = F.lit(0).cast("bigint")
    passages = ["n_passages", F.coalesce("n_repeated_passages", zero).alias("n_repeated_passages")] if passage_words else []
    return found.drop("units").join(spans, "row", "left").select(
        "row", "doc_id", "n_units", "n_chars", F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce("removed", none).alias("removed"), *passages
    )


def line_repeats(docs: DataFrame, min_words: int = MIN_WORDS, passage_words: int | None = None) -> DataFrame:
    """Per document: units, those that stand elsewhere too, spans removed, characters kept, and the spans.

    With ``passage_words`` followed by the runs of clauses, and those of them that stand elsewhere too.
    """
    rows = repeats(docs, min_words=min_words, passage_words=passage_words)
    chars = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r.end - r.start)
    return rows.select(
        "doc_id", "n_units", "n_repeated", F.size("removed").cast("bigint").alias("n_removed"), (F.col("n_chars") - chars).alias("kept_chars"),
        F.array_join(F.transform("removed", lambda r: F.concat(r.start.cast("string"), F.lit(":"), r.end.cast("string"))), ",").alias("removed"),
        *(["n_passages", "n_repeated_passages"] if passage_words else []),
    )


def remove_repeats(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, passage_words: int | None = None) -> DataFrame:
    """The documents with repeated units cut out, and the cut spans (original offsets) in a last column."""
    key, spans = free_name(docs, "row_key"), free_name(docs, "removed_spans")
    rows = _numbered(docs, key)
    cut = repeats(rows, unit, min_words, key, passage_words).select(F.col("row").alias(key), F.col("removed").alias(spans))
    # pieces between the spans: each begins where the span before it ends
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda r: r.end))
    ends = F.concat(F.transform(spans, lambda r: r.start), F.array(F.length("text").cast("bigint")))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    joined = rows.join(cut, key).withColumn("text", F.array_join(pieces, ""))
    return joined.select(*[quoted(c) for c in docs.columns], spans)
