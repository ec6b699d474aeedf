"""Web archives: dictionary-compressed WARC files, written and read back.

An archive is a file ``*.warc.zst``: first a skippable frame with a Zstandard dictionary that was
trained on records of that archive, then one compressed frame per record. Equal payloads of at
least ``REVISIT_BYTES`` are stored once; their other records are revisits without payload.

Defined cases. Null html: empty payload. Null url: empty target. Null page_id: the record's id is
empty; among equal payloads it counts as smaller than any id. Rows that repeat the largest id of a
payload are all responses. An empty table gives no archive and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import file_system
from millrace.session import path_exists, scratch_path

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 * 1024 * 1024  # of records before compression; then the next archive starts
DICT_BYTES = 32 * 1024
DICT_SAMPLES = 2 * 1024 * 1024  # bytes of records the dictionary is trained on
DICT_MAGIC = b"\x5d\x2a\x4d\x18"  # skippable frame 0x184D2A5D, little-endian: the format's fixed value
LEVEL = 3


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, n_bytes, digest): the payload is the html in UTF-8."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")
    )
    return rows.withColumns({"n_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})


def with_originals(pages: DataFrame) -> DataFrame:
    """Adds ``original``: the page whose record holds the payload, null for a page's own record.

    Only digests are grouped, pre-aggregated; payloads move once, to the join. A payload shared by
    very many pages is one row on the grouped side, so adaptive execution can split the other.
    """
    rows = digests(pages)
    large = rows.where(F.col("n_bytes") >= REVISIT_BYTES).select("digest", "page_id")
    shared = large.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
    shared = shared.where(F.col("n") > 1).select("digest", "newest")
    both = rows.join(shared, "digest", "left")
    own = F.col("newest").isNull() | F.col("newest").eqNullSafe(F.col("page_id")) | (F.col("n_bytes") < REVISIT_BYTES)
    return both.withColumn("original", F.when(~own, F.col("newest"))).drop("newest")


def record(page_id, url: str, payload: bytes, digest: str, original) -> bytes:
    """One WARC/1.1 record. Line ends in a URL would break the header and are percent-encoded."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    ident = "" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{ident}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if original is not None:
        lines += [f"WARC-Refers-To: <urn:page:{original}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive: dictionary frame (left out where too few records exist to train one), record frames."""
    samples, total = [], 0
    step = max(1, sum(map(len, records)) // DICT_SAMPLES)
    for r in records[::step]:
        samples.append(r)
        total += len(r)
        if total >= DICT_SAMPLES:
            break
    out, trained = [], None
    if total >= 8 * DICT_BYTES and len(samples) >= 16:
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL, threads=0, k=512, d=8)
        except zstandard.ZstdError:
            trained = None
    if trained is not None:
        content = trained.as_bytes()
        out += [DICT_MAGIC, len(content).to_bytes(4, "little"), content]
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
    else:
        packer = zstandard.ZstdCompressor(level=LEVEL)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def unpack(archive: bytes):
    """Yield (headers, payload) of every record, in order; a file without end is an error."""
    at, trained = 0, None
    if archive[:4] == DICT_MAGIC:
        size = int.from_bytes(archive[4:8], "little")
        content = archive[8 : 8 + size]
        if content[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
            content = zstandard.ZstdDecompressor().decompress(content)
        trained, at = zstandard.ZstdCompressionDict(content), 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(opener.stream_reader(io.BytesIO(memoryview(archive)[at:]), read_across_frames=True), 1 << 20)
    while True:
        first = stream.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
        size = int(headers["content-length"])
        payload = stream.read(size)
        if len(payload) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("record cut short")
        yield headers, payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages as archives below ``folder``; returns (name, n_records, n_bytes), evaluated.

    A task writes its archives under a name of its attempt and then renames them to names made of
    its partition and number, so a repeated task replaces its own files and readers never see a
    part of one. ``folder`` is any location that both Spark and pyarrow's file systems reach.
    """
    rows = with_originals(pages).select("page_id", "url", "payload", "digest", "original")

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        held, size, number = [], 0, 0

        def flush():
            nonlocal held, size, number
            content = pack(held)
            name = f"part-{context.partitionId():06d}-{number:05d}.warc.zst"
            draft = f"{base}/.{name}.{context.taskAttemptId()}"
            with system.open_output_stream(draft, compression=None) as sink:
                sink.write(content)
            system.move(draft, f"{base}/{name}")
            row = pa.RecordBatch.from_pydict({"name": [name], "n_records": [len(held)], "n_bytes": [len(content)]})
            held, size, number = [], 0, number + 1
            return row

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "original")), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    from millrace.session import materialize

    return materialize(rows.mapInArrow(run, "name string, n_records bigint, n_bytes bigint"), "archives-written")


READ_SCHEMA = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``folder``; Spark reads the files, one archive a row.

    The digest of a response is computed from the payload read and must equal the header's.
    """
    if not path_exists(spark, folder):
        return spark.createDataFrame([], READ_SCHEMA)

    def number(header):
        digits = header.removeprefix("<urn:page:").removesuffix(">") if header else ""
        return int(digits) if digits else None

    def run(batches):
        for batch in batches:
            for archive in batch.column("content"):
                rows = []
                for headers, payload in unpack(archive.as_py()):
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = headers["warc-type"]
                    n = int(headers["x-payload-length"])
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n):
                        raise ValueError("payload does not match its digest")
                    held = payload if payloads and kind == "response" else None
                    rows.append((number(headers["warc-record-id"]), headers["warc-target-uri"], held, n, digest, kind, number(headers.get("warc-refers-to"))))
                    if len(rows) >= 2000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows):
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(run, READ_SCHEMA)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to a new folder of the shared scratch space and read the records back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder)
    records = read_archives(spark, folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
m AS (SELECT payload_digest AS d, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN newest IS NULL OR newest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN newest IS NULL OR newest = page_id THEN NULL ELSE newest END AS refers_to
FROM p LEFT JOIN m ON payload_digest = d
"""
