"""Personal data: base patterns, and terms that disclose protected values.

Base: emails, IP addresses, payment cards and phone numbers by pattern. The method: a value (one
email, one number) is protected, and words near it may give it away. Over the whole corpus it is
counted in how many distinct contexts of the value a term stands, and in how many documents at all.
The pointwise mutual information of term and value, as a share of the value's own information, says
how much of the value the term discloses; from ``SHARE`` on the term is masked next to that value.

    information(v) = log2(documents / contexts(v))
    pmi(t, v) = log2(contexts(v with t) * documents / (contexts(v) * documents(t)))

Copies of a passage are one context. A term needs ``SUPPORT`` distinct contexts of the value and
``PART`` of all of them, which bounds the terms of a value at ``2 * WINDOW / PART``.

Defined cases. Null text: empty, no spans. Repeated rows get equal results, and count as documents.
Digit strings of any length are judged by value. Empty table: no rows. Other columns are not read;
``sanitise`` passes them through.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import by_slice, free_name, id_and_text, map_by_place, slices_of
from millrace.session import materialize

WINDOW = 8  # terms on each side of a value
REACH = 160  # characters on each side that are searched for them
SUPPORT = 3
PART = 0.05
SHARE = 0.8
LEAST_BITS = 3.0
HELD = 150_000

KINDS = ["email", "ip", "card", "phone"]
_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches: each needs one @, and its local part is the run of letters before it."""
    done = 0
    for m in _TAIL.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all kinds, by start and then kind; code points, end exclusive."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for part in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def protected_value(kind: int, value: str) -> str:
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _NOT_DIGIT.sub('', value)}"


def contexts(text: str, spans) -> list[dict]:
    """Terms near each value: (value, context, term, start, end). No term overlaps a base span."""
    out, last = [], 0
    for at, (start, kind, end) in enumerate(spans):
        before, last = last, max(last, end)
        after = spans[at + 1][0] if at + 1 < len(spans) else len(text)
        low, high = max(0, start - REACH, before), min(len(text), end + REACH, max(after, end))
        # a word cut by the reach is left out
        left = [m for m in _TERM.finditer(text, low, start) if m.start() > low or low in (0, before)][-WINDOW:]
        right = [m for m in _TERM.finditer(text, end, high) if m.end() < high or high in (len(text), after)][:WINDOW]
        terms = [(m.group().lower(), m.start(), m.end()) for m in left + right]
        mark = xxhash.xxh3_64_intdigest(" ".join(t for t, *_ in terms).encode("utf-8", "surrogatepass")) - (1 << 63)
        value = protected_value(kind, text[start:end])
        out += [{"value": value, "context": mark, "term": t, "start": a, "end": b} for t, a, b in terms]
    return out


_CONTEXTS = pa.list_(pa.struct([("value", pa.string()), ("context", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
FOUND = (
    "spans array<struct<start: bigint, kind: int, end: bigint>>, "
    "near array<struct<value: string, context: bigint, term: string, start: bigint, end: bigint>>"
)


def find(rows: DataFrame) -> DataFrame:
    """(row, doc_id, spans, near) from (row, doc_id, text); written once, without texts."""

    def make():
        def apply(batch):
            texts = batch.column("text").to_pylist()
            spans = [base_spans(t) for t in texts]
            near = [contexts(t, s) if s else [] for t, s in zip(texts, spans, strict=True)]
            columns = [
                batch.column("row"), batch.column("doc_id"),
                pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in spans], _SPANS), pa.array(near, _CONTEXTS),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "spans", "near"])

        return apply

    return materialize(by_slice(rows, make, "row bigint, doc_id bigint, " + FOUND), "personal-data")


def document_counts(rows: DataFrame) -> DataFrame:
    """(term, n): documents that hold each term, counted per task first, in bounded memory."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            batch = pa.RecordBatch.from_pydict({"term": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            for part in slices_of(batch):
                for text in part.column("text").to_pylist():
                    held.update(set(_TERM.findall(text.lower())))
                if len(held) > HELD:
                    yield flush()
        yield flush()

    return rows.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(value, term, bits, share) of the pairs over the thresholds."""
    near = found.select(F.explode("near").alias("n")).select("n.value", "n.context", "n.term").distinct()
    values = near.select("value", "context").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_value"))
    pairs = near.groupBy("value", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= SUPPORT)
    pairs = materialize(pairs.join(values, "value").where(F.col("n_both") >= PART * F.col("n_value")), "candidate-pairs")
    total = F.lit(found.count())
    wanted = pairs.select("term").distinct()
    counted = document_counts(rows).join(wanted, "term", "left_semi")
    scored = pairs.join(counted, "term").withColumn("n_docs", total)
    bits = F.log2(F.col("n_both") * F.col("n_docs") / (F.col("n_value") * F.greatest("n", "n_both")))
    information = F.log2(F.col("n_docs") / F.col("n_value"))
    scored = scored.select("value", "term", bits.alias("bits"), (bits / information).alias("share"))
    return scored.where((F.col("bits") >= LEAST_BITS) & (F.col("share") >= SHARE))


def _rows(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).withColumn("row", F.monotonically_increasing_id())


def disclosures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, terms): ``find`` of the rows, and (row, terms) with the spans of disclosing terms."""
    found = find(rows)
    telling = materialize(disclosing_terms(rows, found).select("value", "term"), "disclosing-terms")
    near = found.select("row", F.explode("near").alias("n")).select("row", "n.value", "n.term", "n.start", "n.end")
    masked = near.join(telling, ["value", "term"]).select("row", F.struct("start", F.lit(len(KINDS)).alias("kind"), "end").alias("span"))
    return found, masked.groupBy("row").agg(F.collect_set("span").alias("terms"))


def all_spans(rows: DataFrame) -> DataFrame:
    """(row, doc_id, spans, every): base spans, and those with the disclosing terms'; ``kind`` 4 is a term."""
    found, terms = disclosures(rows)
    none = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")
    joined = found.drop("near").join(terms, "row", "left")
    return joined.withColumn("every", F.array_sort(F.concat("spans", F.coalesce("terms", none)))).drop("terms")


def _listed(spans):
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: counts by kind, digest of the base spans, all spans."""
    rows = all_spans(_rows(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("bigint")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("every")).alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with values generalised to their kind (``[EMAIL]``) and disclosing terms to ``[TERM]``.

    Overlapping spans are generalised as one, under the kind that begins first.
    """
    key, marks = free_name(docs, "row_key"), free_name(docs, "pii_spans")
    numbered = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(
        F.col(key).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    spans = all_spans(rows).where(F.size("every") > 0).select(F.col("row").alias(key), F.col("every").alias(marks))
    joined = numbered.join(spans, key, "left")
    at, marks_at = joined.columns.index("text"), joined.columns.index(marks)
    kept = [joined.columns.index(c) for c in docs.columns]
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts = [
                generalise(t, [(s["start"], s["kind"], s["end"]) for s in found]) if found else t
                for t, found in zip(batch.column(at).to_pylist(), batch.column(marks_at).to_pylist(), strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_by_place(joined, run, schema)


def generalise(text: str, spans) -> str:
    names, out, done, last = [k.upper() for k in KINDS] + ["TERM"], [], 0, 0
    for start, kind, end in sorted(spans):
        if start >= last:
            out += [text[done:start], f"[{names[kind]}]"]
        done = last = max(last, end)
    return "".join([*out, text[done:]])
