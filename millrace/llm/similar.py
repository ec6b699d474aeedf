"""Links between texts whose sets of word shingles have a Jaccard similarity of ``SIMILARITY`` or more.

A set-similarity join by prefix filter. The shingles of all texts have one order. Of a set of n
shingles the first ``n - ceil(t n) + 1`` are its prefix; two sets of similarity t or more share a
shingle of both prefixes, so texts that meet in the bucket of a prefix shingle are all the candidates
there are. The order puts shingles of many texts last, which keeps buckets small; the counts come
from a part of the texts, and what they miss costs time only, never a link.

Pairs of a bucket of at most ``CROWD`` texts are compared one by one by the sizes of their
intersections, if their prefixes share as many shingles as similar sets must. In a larger bucket a text is compared with all others through the lists of texts that
hold its shingles, texts of the most shared shingles first, until every text is in the largest
component or has been compared with all. A bucket is cut into pieces of ``PIECE`` shingles, and all
pairs of pieces meet, each in a task of bounded memory.

Defined cases. Words are split at white space, in lower case. A text of fewer words than a shingle is one
shingle; null and blank texts have the empty set and are equal to each other. Equal sets are one
vertex, told apart by a 64-bit digest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import by_slice, free_name
from millrace.session import forget, materialize

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
CROWD = 64
PIECE = 1_000_000
COUNTED = 16  # one text in so many is counted for the order
OFTEN = 4  # counted texts that make a shingle a frequent one
MOST = 1 << 17  # frequent shingles that are broadcast
BROADCAST_KEYS = 250_000
_CLOSE = 1e-9  # similarities are ratios of whole numbers


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        spans = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), ">u8").astype(np.uint64))


def set_digest(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def prefix_of(shingles: np.ndarray, similarity: float, often: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first shingles in the order: by hash, and frequent ones (sorted, with places) last."""
    n = len(shingles)
    size = n - math.ceil(similarity * n - _CLOSE) + 1 if n else 0
    if len(often) and n:
        at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
        is_often = often[at] == shingles
        late = shingles[is_often][np.argsort(place[at[is_often]])]
        shingles = np.concatenate([shingles[~is_often], late])
    return shingles[:size]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of many counted texts, sorted, and their places in the order."""

    def make():
        def apply(batch):
            found = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

        return apply

    part = rows.where(F.pmod(F.col("row_key"), F.lit(COUNTED)) == 0)
    counts = by_slice(part, make, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    top = counts.orderBy(F.desc("n"), "shingle").limit(MOST).collect()
    shingles = np.array([r.shingle for r in top], np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], -order  # the most frequent is last


def row_key(docs: DataFrame):
    """A number that is equal for rows of equal doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))


def rows_of(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows whose key is among ``keys`` (left_semi) or not (left_anti). Few keys, by count, go to the rows."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    name = free_name(docs, "wanted_key")
    keys = keys.select(F.col("row_key").alias(name))
    return docs.join(F.broadcast(keys) if few else keys, row_key(docs) == F.col(name), how)


def with_prefixes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, row_key, fp, n, prefix): the digest and size of each text's set, and its prefix."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), row_key(docs).alias("row_key"))
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(rows, shingle))  # at most MOST of each

    def make():
        often, place = shared.value

        def apply(batch):
            found = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("doc_id"), batch.column("row_key"),
                pa.array(np.array([set_digest(s) for s in found], np.uint64).view(np.int64)), pa.array([len(s) for s in found], pa.int64()),
                _lists([prefix_of(s, similarity, often, place) for s in found]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "fp", "n", "prefix"])

        return apply

    return by_slice(rows, make, "doc_id bigint, row_key bigint, fp bigint, n bigint, prefix array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, repeated: bool) -> DataFrame:
    """(fp, shingles) of the rows whose keys are wanted, one row per set.

    Each set has one key among ``wanted``. Only if rows repeat id and text (``repeated``) it has several rows.
    """

    def make():
        def apply(batch):
            found = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            prints = pa.array(np.array([set_digest(s) for s in found], np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([prints, _lists(found)], names=["fp", "shingles"])

        return apply

    rows = rows_of(docs, wanted, "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    sets = by_slice(rows, make, "fp bigint, shingles array<bigint>")
    return sets.dropDuplicates(["fp"]) if repeated else sets


def link_crowd(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the components of similar sets; not every pair is listed."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    owner = owner[order]
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    first = np.cumsum(count) - count
    begins = np.cumsum(sizes) - sizes
    # texts of the most shared shingles first: they are likely to be similar to many
    shared = np.array([count[number[b : b + n]].sum() for b, n in zip(begins, sizes, strict=True)])
    root, made = np.arange(m), []
    done = np.zeros(m, bool)
    queue = np.argsort(-shared, kind="stable")
    while True:
        queue = queue[~done[queue] & (root[queue] != np.bincount(root, minlength=m).argmax())] if done.any() else queue
        if not len(queue):
            return made
        a = int(queue[0])
        done[a] = True
        mine = number[begins[a] : begins[a] + sizes[a]]
        mine = mine[count[mine] > 1]
        both = np.zeros(m, np.int64)
        if len(mine):
            length = count[mine]
            at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[mine], length)
            both = np.bincount(owner[at], minlength=m)
        similar = both >= similarity * (sizes + sizes[a] - both) - _CLOSE
        similar &= root != root[a]
        for r in np.unique(root[similar]):
            b = int(np.flatnonzero(similar & (root == r))[0])
            made.append((a, b))
        joined = np.unique(np.append(root[similar], root[a]))
        if len(joined) > 1:
            root[np.isin(root, joined)] = joined[0]


def _crowd_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the buckets of more than ``CROWD`` texts."""
    here = Window.partitionBy("shingle").orderBy("n", "fp")
    big = members.where(F.col("m") > CROWD).withColumn("piece", F.floor(F.sum("n").over(here.rowsBetween(Window.unboundedPreceding, 0)) / PIECE).cast("int"))
    last = big.groupBy("shingle").agg(F.max("piece").alias("last"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("last")),
        lambda o: F.struct(F.least("piece", o).alias("low"), F.greatest("piece", o).alias("high")),
    )
    dealt = big.join(last, "shingle").select("shingle", "fp", F.explode(pairs).alias("pair")).select("shingle", "pair.low", "pair.high", "fp")
    group = ["shingle", "low", "high"]
    parts = dealt.join(sets, "fp").repartition(*group).sortWithinPartitions(*group, "fp")

    def run(batches):
        held_prints, held_sets, key = [], [], None

        def close():
            links = link_crowd(held_sets, similarity)
            a, b = [[held_prints[p[i]] for p in links] for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in group], strict=True))
            prints, lists = batch.column("fp").to_pylist(), batch.column("shingles")
            flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for i, here_ in enumerate(keys):
                if here_ != key:
                    if key is not None:
                        yield close()
                    held_prints, held_sets, key = [], [], here_
                held_prints.append(prints[i])
                held_sets.append(flat[ends[i] : ends[i + 1]].copy())
        if key is not None:
            yield close()

    return parts.select(*group, "fp", "shingles").mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, found: DataFrame, prints: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between set digests that join all similar sets in chains.

    ``found``: ``with_prefixes``, written by ``materialize``; it is deleted as soon as the buckets are written.
    ``prints``: its columns but the prefixes, written too.
    """
    rows = found.select("fp", F.explode("prefix").alias("shingle"))
    again = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("shingle")
    again = materialize(again, "shared-shingles")  # one row per key, written, so that a hot one is split in the join
    shared = materialize(rows.join(again, "shingle").distinct(), "shared")  # copies are one set from here
    sizes = materialize(shared.groupBy("shingle").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1), "bucket-sizes")
    members = materialize(shared.join(sizes, "shingle").join(prints.select("fp", "n").distinct(), "fp"), "members")
    forget(found)
    few = members.where(F.col("m") <= CROWD)
    left, right = [few.select("shingle", F.col("fp").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab"]
    sized = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - _CLOSE
    met = left.join(right, "shingle").where((F.col("a") < F.col("b")) & sized)
    met = met.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("common"))
    # Of the prefix that ends first in the order, all shingles but those the other set may lack are common
    # to both prefixes. Those in large buckets are not counted here, so they are taken as common.
    crowded = members.where(F.col("m") > CROWD).groupBy("fp").agg(F.count(F.lit(1)).alias("crowded"))
    for k in "ab":
        met = met.join(crowded.select(F.col("fp").alias(k), F.col("crowded").alias(f"crowded_{k}")), k, "left")
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - _CLOSE)
    needed = F.least(*[overlap - F.ceil(F.col(n) * similarity - _CLOSE) + 1 for n in ("n_a", "n_b")])
    uncounted = F.least(*[F.coalesce(c, F.lit(0)) for c in ("crowded_a", "crowded_b")])
    pairs = materialize(met.where(F.col("common") + uncounted >= needed).select("a", "b", "n_a", "n_b"), "candidates")
    asked = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).unionByName(crowded.select("fp")).distinct()
    wanted = prints.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("row_key").alias("row_key"))
    repeated = not prints.groupBy("row_key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).isEmpty()
    sets = materialize(_sets(docs, materialize(wanted, "wanted"), shingle, repeated), "shingle-sets")
    for k in "ab":
        pairs = pairs.join(sets.select(F.col("fp").alias(k), F.col("shingles").alias(f"set_{k}")), k)
    both = F.size(F.array_intersect("set_a", "set_b"))
    near = pairs.where(both >= similarity * (F.col("n_a") + F.col("n_b") - both) - _CLOSE).select("a", "b")
    return near.unionByName(_crowd_links(members, sets, similarity))
