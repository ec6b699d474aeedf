"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 majority bits of the XXH64 hashes of 4-word shingles. Links: at most ``RADIUS``
differing bits.

Distinct fingerprints meet in buckets: of ``BLOCKS`` bit blocks at least ``BLOCKS - RADIUS`` are equal
in a linked pair, so every pair of blocks is a bucket key and no link is missed. In a bucket the
fingerprints are sorted by Gray rank, which brings equal bit patterns together; nodes above them
hold the bits that all fingerprints below share. Two nodes whose shared bits differ in more than
``RADIUS`` places are pruned with all below them. The index links components: a pair of nodes
that already lie in one component is not opened, so a bucket gives at most one link per member.

Buckets are cut along the Gray order into pieces of ``PIECE``; all pairs of pieces of a bucket meet,
each in a task of bounded memory. Ordinary buckets are one piece.

Defined cases. Null or blank text: fingerprint zero, linked like any other. Repeated rows and equal
ids: one row out per row in; copies share a fingerprint, which is one vertex. A null doc_id takes
part, but is never the smallest unless all of a component are null. Empty table: no rows. Other
columns are not read; ``keep_one`` passes them through.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import similar
from millrace.llm.common import by_slice, free_name, id_and_text, quoted, slices_of
from millrace.llm.graph import components
from millrace.session import materialize

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = (11, 11, 11, 11, 10, 10)  # bits; two of the six are equal in any pair within the radius
PIECE = 16_384
FANOUT = 8


def fingerprint(text: str) -> int:
    """Bit i is 1 if set in over half the shingles' hashes; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_digest
    spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit integers."""

    def make():
        def apply(batch):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

        return apply

    return by_slice(id_and_text(docs), make, "doc_id bigint, fp bigint")


# --- the index ---------------------------------------------------------------------------------


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each pattern in the Gray sequence: prefix XOR from the highest bit down."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; a node keeps the bits all below it share."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        ones, zeros = fps, ~fps
        self.levels = [(ones, zeros)]  # bits that are 1 in all below, bits that are 0 in all below
        while len(ones) > 1:
            cut = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            self.levels.append((ones, zeros))

    def links(self, other: GrayIndex, root: np.ndarray, shift: int) -> list[tuple[int, int]]:
        """Links between components of ``self`` and ``other`` (whose members begin at ``shift``).

        ``root`` is the union-find of all members and is updated. Node pairs are opened level by
        level; of the leaf pairs in reach only those of different components are united.
        """
        made: list[tuple[int, int]] = []
        depth = max(len(self.levels), len(other.levels)) - 1
        stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        same = self is other
        while stack:
            level, left, right = stack.pop()
            if len(left) > 65_536:  # bounded work lists: halves, the nearer one first
                half = len(left) // 2
                stack += [(level, left[half:], right[half:]), (level, left[:half], right[:half])]
                continue
            la, lb = min(level, len(self.levels) - 1), min(level, len(other.levels) - 1)
            (a1, a0), (b1, b0) = self.levels[la], other.levels[lb]
            apart = (a1[left] & b0[right]) | (a0[left] & b1[right])
            near = np.bitwise_count(apart) <= RADIUS
            left, right = left[near], right[near]
            if level == 0:
                if same:
                    later = right > left
                    left, right = left[later], right[later]
                for a, b in zip(left.tolist(), (right + shift).tolist(), strict=True):
                    ra, rb = _find(root, a), _find(root, b)
                    if ra != rb:
                        root[max(ra, rb)] = min(ra, rb)
                        made.append((a, b))
                continue
            if len(left):
                # a pair of nodes in one component each, and in the same one, holds nothing new
                one_a, one_b = self._uniform(la, root, 0), other._uniform(lb, root, shift)
                ca, cb = one_a[left], one_b[right]
                open_ = ~((ca >= 0) & (ca == cb))
                left, right = left[open_], right[open_]
                down = min(level - 1, len(self.levels) - 1) < la, min(level - 1, len(other.levels) - 1) < lb
                stack.append((level - 1, *self._open(left, right, other, la, lb, down, same)))
        return made

    def _uniform(self, level: int, root: np.ndarray, shift: int) -> np.ndarray:
        """Per node of a level the one component all its members are in, or -1."""
        while not np.array_equal(root[root], root):
            root[:] = root[root]
        own = root[shift : shift + len(self.fps)]
        for _ in range(level):
            cut = np.arange(0, len(own), FANOUT)
            low, high = np.minimum.reduceat(own, cut), np.maximum.reduceat(own, cut)
            own = np.where(low == high, low, -1)
        return own

    def _open(self, left, right, other, la, lb, down, same):
        """The node pairs one level down."""
        if down[0]:
            size = len(self.levels[la - 1][0])
            left, right = (left[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(right, FANOUT)
            good = left < size
            left, right = left[good], right[good]
        if down[1]:
            size = len(other.levels[lb - 1][0])
            right, left = (right[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(left, FANOUT)
            good = right < size
            left, right = left[good], right[good]
        if same:
            ordered = right >= left
            left, right = left[ordered], right[ordered]
        return left, right


def _find(root: np.ndarray, at: int) -> int:
    while root[at] != at:
        root[at] = root[root[at]]
        at = int(root[at])
    return at


def link_pieces(first: np.ndarray, second: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that join the components of one piece, or those between two; places in both together."""
    a = GrayIndex(first)
    if second is None:
        root = np.arange(len(first))
        near = np.flatnonzero(np.bitwise_count(first[1:] ^ first[:-1]) <= RADIUS)  # neighbours in Gray order first
        made = [(int(i), int(i) + 1) for i in near]
        for x, y in made:
            rx, ry = _find(root, x), _find(root, y)
            root[max(rx, ry)] = min(rx, ry)
        return made + a.links(a, root, 0)
    b = GrayIndex(second)
    root = np.arange(len(first) + len(second))
    # what is linked within each piece needs no second look here; it only helps to prune
    for index, shift in ((a, 0), (b, len(first))):
        for x, y in link_pieces(index.fps, None):
            rx, ry = _find(root, x + shift), _find(root, y + shift)
            root[max(rx, ry)] = min(rx, ry)
    return a.links(b, root, len(first))


# --- in Spark ----------------------------------------------------------------------------------


def _bucket_keys() -> list[int]:
    """Masks of two blocks each."""
    masks, at = [], 64
    for size in BLOCKS:
        at -= size
        masks.append(((1 << size) - 1) << at)
    return [a | b for a, b in itertools.combinations(masks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(vertices: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints that join all that are within ``RADIUS`` in a chain.

    ``vertices``: (fp). Not every linked pair is listed: each bucket gives a spanning set.
    """
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(_bucket_keys())])
    ordered = rank.bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    rows = vertices.select("fp", ordered.alias("rank"), F.explode(keys).alias("key")).select("fp", "rank", "key.mask", "key.bits")
    sizes = rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    rows = rows.join(sizes, ["mask", "bits"])  # a fingerprint alone in its bucket has no links there
    place = F.row_number().over(Window.partitionBy("mask", "bits").orderBy("rank")) - 1
    piece = F.floor(place / PIECE).cast("int")
    last = F.floor((F.col("n") - 1) / PIECE).cast("int")
    rows = rows.withColumn("piece", piece).withColumn("last", last)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("last")),
        lambda o: F.struct(F.least("piece", o).alias("low"), F.greatest("piece", o).alias("high")),
    )
    dealt = rows.select("mask", "bits", "fp", "piece", F.explode(pairs).alias("pair")).select("mask", "bits", "pair.low", "pair.high", "piece", "fp")
    group = ["mask", "bits", "low", "high"]
    parts = dealt.repartition(*group).sortWithinPartitions(*group, "piece")

    def run(batches):
        held: list[np.ndarray] = []
        key, out_a, out_b = None, [], []

        def close():
            fps = np.concatenate(held, axis=1)
            pieces, values = fps[0], fps[1].view(np.uint64)
            halves = [values[pieces == p] for p in np.unique(pieces)]
            halves = [h[np.argsort(gray_rank(h))] for h in halves]
            if key[2] != key[3] and len(halves) < 2:
                return
            both = np.concatenate(halves).view(np.int64)
            for a, b in link_pieces(halves[0], halves[1] if key[2] != key[3] else None):
                out_a.append(int(both[a]))
                out_b.append(int(both[b]))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
            out_a.clear()
            out_b.clear()
            return batch

        for batch in batches:
            columns = [np.asarray(batch.column(c)) for c in (*group, "piece", "fp")]
            new = np.zeros(batch.num_rows, bool)
            for c in columns[:4]:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                if a == b:
                    continue
                here = tuple(int(c[a]) for c in columns[:4])
                if here != key:
                    if held:
                        close()
                    held, key = [], here
                held.append(np.stack([columns[4][a:b].astype(np.int64), columns[5][a:b]]))
            if len(out_a) > 50_000:
                yield flush()
        if held:
            close()
        yield flush()

    return parts.mapInArrow(run, "a bigint, b bigint")


def fingerprint_groups(prints: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(fp, component_id, keeper): a fingerprint's component, named by its smallest doc_id.

    ``keeper`` tells the one fingerprint of the component whose documents include that id. ``links``
    replaces those within ``RADIUS``.
    """
    smallest = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = components(near_links(smallest.select("fp")) if links is None else links)
    rooted = smallest.join(linked.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # nulls last: a struct's first field says whether the id is missing
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("best")
    heads = rooted.groupBy("root").agg(best).select("root", F.col("best.least").alias("component_id"), F.col("best.fp").alias("keeper"))
    return rooted.join(heads, "root").select("fp", "component_id", (F.col("keeper") == F.col("fp")).alias("keeper"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    prints = materialize(fingerprints(docs), "fingerprints")
    groups = materialize(fingerprint_groups(prints).drop("keeper"), "groups")
    joined = prints.join(groups, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one of smallest doc_id.

    Among rows that repeat this id with the same fingerprint, the first by all columns stays.
    """
    name = free_name(docs, "fp")
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(text_at)], names=["text"])
            found = [fingerprint(t or "") for part in slices_of(texts) for t in part.column("text").to_pylist()]
            prints = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, name])

    from pyspark.sql.types import LongType, StructType

    marked = docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, LongType()))
    prints = materialize(marked.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(name).alias("fp")), "fingerprints")
    groups = fingerprint_groups(prints).where("keeper")
    winners = groups.select(F.col("component_id").alias("__id"), F.col("fp").alias("__fp"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col(name) == F.col("__fp"))
    kept = marked.join(winners, same, "left_semi")
    order = Window.partitionBy("doc_id", name).orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    rank = free_name(docs, "rank_of_copy")
    return kept.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*[F.col(quoted(c)) for c in docs.columns])


def index_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): links between set digests that join all texts whose fingerprints the index links.

    ``rows``: (row_key, fp) of all rows, with the digests of their shingle sets.
    """
    prints = fingerprints(docs.select(similar.row_key(docs).alias("doc_id"), "text")).toDF("row_key", "print")
    both = materialize(rows.select("row_key", "fp").join(prints.distinct(), "row_key").select("print", "fp").distinct(), "prints-of-sets")
    heads = materialize(both.groupBy("print").agg(F.min("fp").alias("head")), "distinct-fingerprints")
    equal = both.join(heads, "print").select(F.col("head").alias("a"), F.col("fp").alias("b")).where("a <> b")
    near = near_links(heads.select(F.col("print").alias("fp")))
    for k in "ab":
        near = near.join(heads.select(F.col("print").alias(k), F.col("head").alias(f"head_{k}")), k)
    return materialize(equal.unionByName(near.select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))), "index-links")


def keep_one_similar(docs: DataFrame, shingle: int = similar.SHINGLE, similarity: float = similar.SIMILARITY, index: bool = False) -> DataFrame:
    """One document of each group of near copies, chosen as by ``keep_one``.

    Texts are linked if their shingle sets are similar and, with ``index``, also if the index links their
    fingerprints, as in ``near_duplicates``. The radius alone misses most texts of similarity 0.8.
    """
    found = materialize(similar.with_prefixes(docs, shingle, similarity), "prefixes")
    rows = materialize(found.select("doc_id", "row_key", "fp", "n"), "set-digests")
    near = index_links(docs, rows) if index else None
    linked = similar.links(docs, found, rows, shingle, similarity)
    linked = linked.unionByName(near) if index else linked
    groups = fingerprint_groups(rows.select("doc_id", "fp"), linked).where("keeper")
    winners = groups.select(F.col("component_id").alias("__id"), F.col("fp").alias("__fp"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp"))
    losers = materialize(rows.join(winners, same, "left_anti").select("row_key").distinct(), "losers")
    kept = similar.rows_of(docs, losers, "left_anti")
    # texts stay where they are, but for rows that repeat both the id and the set of a kept one
    again = rows.join(winners, same, "left_semi").groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    matched = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("fp") == F.col("__fp"))
    again = again.select(F.col("doc_id").alias("__doc"), F.col("fp").alias("__fp"))
    again = materialize(rows.join(again, matched).select("row_key", "__doc", "__fp").distinct(), "repeated")
    if again.isEmpty():
        return kept
    key, doc, fp, rank = (free_name(docs, c) for c in ("copy_key", "copy_doc", "copy_fp", "rank_of_copy"))
    order = Window.partitionBy(doc, fp).orderBy(*[F.col(quoted(c)) for c in docs.columns])
    named = again.toDF(key, doc, fp)
    copies = similar.rows_of(kept, again, "left_semi").join(named, similar.row_key(kept) == F.col(key))
    first = copies.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*[F.col(quoted(c)) for c in docs.columns])
    return similar.rows_of(kept, again, "left_anti").unionByName(first)
