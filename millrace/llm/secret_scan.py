"""Secret scans over a ledger of blobs: every content is scanned once per rule version, whatever holds it.

A version is a text at a path (a document, a file at a commit). Its content is addressed by SHA-256; equal
contents of any paths and times are one blob. The ledger is a table of (blob, rules, spans): which rule
versions have read a blob, and what they found. A scan takes the versions, finds the pairs of blob and rule
version the ledger does not hold, reads one carrier of each such blob with the missing rules only, appends
the findings, empty ones included, and joins the ledger back to all paths.

A rule's version is the digest of its whole definition, so a changed rule is a new version and the old
findings stay for those who ask for them.

In Spark. Texts are hashed where they are; blobs and carriers are tables of keys. Only texts of unseen
blobs move, spread by (blob, version), so a content that a third of the rows hold is no hot key; rows of a
hot blob are joined with a ledger table that holds one row per blob, written before, which adaptive
execution splits. An append is one folder, renamed into the ledger when complete: a lost executor or a
stopped run leaves the ledger as it was, and a repeated run finds its pairs seen.

Base kinds: assign (key names in either case of a-z; the value has 6 or more characters), access (20 or
more), hex (24 or more): leftmost non-overlapping matches per kind, failing ones dropped without a retry.
Further kinds are this operator's own. Spans are code points, end exclusive.

Defined cases. A null text is the empty text. Repeated rows and ids: a row out per row in. A null path stays
null. Very long texts are scanned whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import by_slice, texts_of
from millrace.session import materialize, path_exists, scratch_path


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` or more characters.

    ``hints``: in ASCII lower case, one of these stands in every text that can match; none: always read.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    either_case: bool = False
    hints: tuple[str, ...] = ()

    @cached_property
    def version(self) -> str:
        parts = (self.kind, self.pattern, str(self.group), str(self.least), str(self.either_case))
        return f"{self.kind}-{hashlib.sha256(chr(0).join(parts).encode()).hexdigest()[:16]}"

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.either_case else 0))

    def may_match(self, text: str, low: str) -> bool:
        return not self.hints or any(h in low for h in self.hints)


# The base kinds in their order, then this operator's own.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6, either_case=True, hints=("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, hints=("akia",)),
    # a run of 24 is found where the whole run begins, so the count may stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
OWN = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", hints=("private key-----",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}", hints=("aiza",)),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/@]{1,64})@", group=1, hints=("://",)),
)
RULES = BASE + OWN

LEDGER = "blob binary, rules array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"


def find(text: str, rules: list[Rule], compiled: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    """(rule version, start, end) of every match, rule by rule."""
    low = text.lower()
    found = []
    for rule in rules:
        if rule.may_match(text, low):
            for m in compiled[rule.version].finditer(text):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    found.append((rule.version, *m.span()))
    return found


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Ledger:
    """Findings of (blob, rule version) pairs below a folder that all executors reach.

    Each append is a folder ``run-*``; it counts once it has been renamed, which is one step.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def runs(self) -> list[str]:
        if not path_exists(self.spark, self.path):
            return []
        fs, folder = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(f"{self.path}/{n}" for n in names if n.startswith("run-"))

    def read(self) -> DataFrame:
        runs = self.runs()
        return self.spark.read.schema(LEDGER).parquet(*runs) if runs else self.spark.createDataFrame([], LEDGER)

    def append(self, findings: DataFrame) -> None:
        name = scratch_path(self.spark, "run").rsplit("/", 1)[1]
        findings.write.parquet(f"{self.path}/_{name}")
        fs, written = self._fs(f"{self.path}/_{name}")
        if not fs.rename(written, self._fs(f"{self.path}/{name}")[1]):
            raise OSError(f"cannot complete {name} of the ledger")


def unseen(blobs: DataFrame, ledger: DataFrame, rules) -> DataFrame:
    """(blob, ..., missing): the rows whose blob lacks rule versions in the ledger, and which."""
    wanted = F.array(*[F.lit(r.version) for r in rules])
    seen = ledger.select("blob", F.explode(F.array_intersect("rules", wanted)).alias("rule"))
    seen = materialize(seen.groupBy("blob").agg(F.collect_set("rule").alias("seen")), "seen")  # as many as there are rules
    missing = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").withColumn("missing", missing).drop("seen").where(F.size("missing") > 0)


def scan(versions: DataFrame, ledger: Ledger, path: str = "path", text: str = "text", rules=RULES, told_by: tuple[str, ...] = ()) -> DataFrame:
    """Bring the ledger up to date for all versions; returns (path, blob) of every version.

    ``told_by`` names columns (commit, time) that tell versions of one path apart; one version of each
    unseen content is read. Versions that are equal in these, path and text count as one within a task; if
    adaptive execution has dealt them to several, they are read in each and reported once.
    """
    at = F.xxhash64(*[F.col(f"`{c}`") for c in (path, *told_by)])
    held = versions.select(F.col(f"`{path}`").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), at.alias("at"))
    held = held.withColumn("blob", blob_of(F.col("text")))
    places = materialize(held.select("path", "blob", "at"), "versions")
    carriers = places.groupBy("blob").agg(F.min("at").alias("at"))  # copies are combined before the shuffle
    due = unseen(carriers, ledger.read(), rules).select(F.col("blob").alias("due"), F.col("at").alias("carrier"), "missing")
    due = materialize(due, "unseen-blobs")
    same = (F.col("blob") == F.col("due")) & (F.col("at") == F.col("carrier"))
    # the keys are hashed per task, so texts are not sorted
    texts = held.join(due.hint("shuffle_hash"), same).select("blob", "text", "missing")

    def make():
        compiled, done = {r.version: r.compiled() for r in rules}, set()

        def apply(batch):
            blobs = batch.column("blob").to_pylist()
            new = [at for at, blob in enumerate(blobs) if blob not in done and not done.add(blob)]
            batch = batch.take(pa.array(new, pa.int64()))
            found = [
                [dict(rule=v, start=a, end=b) for v, a, b in find(t, [r for r in rules if r.version in missing], compiled)]
                for t, missing in zip(texts_of(batch), batch.column("missing").to_pylist(), strict=True)
            ]
            kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("missing"), pa.array(found, kind)], names=["blob", "rules", "spans"]
            )

        return apply

    ledger.append(by_slice(texts, make, LEDGER))
    return places.drop("at")


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans): per blob of the ledger all spans of these rule versions as (kind, start, end, place), in order.

    Spans are ordered by start and then by the rules' order. A span that several appends hold counts once.
    """
    versions = F.array(*[F.lit(r.version) for r in rules])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    own = F.filter("spans", lambda s: F.array_contains(versions, s["rule"]))
    listed = F.transform(
        own,
        lambda s: F.struct(
            s["start"].alias("start"), F.array_position(versions, s["rule"]).cast("int").alias("place"), s["end"].alias("end")
        ),
    )
    rows = ledger.where(F.arrays_overlap("rules", versions)).select("blob", listed.alias("spans"))
    merged = rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    named = F.transform("spans", lambda s: F.struct(F.element_at(kinds, s["place"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["place"].alias("place")))
    return merged.select("blob", named.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def secrets(docs: DataFrame, ledger: Ledger | None = None, rules=RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    Without a ledger a new one is begun in the scratch folder.
    """
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, scratch_path(spark, "ledger"))
    places = scan(docs, ledger, "doc_id", "text", rules)
    base = F.filter("spans", lambda s: s["place"] <= len(BASE))
    counts = [_count(r.kind).alias(f"n_{r.kind}") for r in BASE]
    digest = F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256")
    found = findings(ledger.read(), rules).select("blob", *counts, digest, _joined(F.col("spans")).alias("spans"))
    found = materialize(found, "findings")  # one row per blob; the paths' side of the join may be split
    return places.select(F.col("path").cast("bigint").alias("doc_id"), "blob").join(found, "blob").drop("blob")
