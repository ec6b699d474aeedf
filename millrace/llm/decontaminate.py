"""Benchmark decontamination by q-gram lemma filtering.

A benchmark text of m characters occurs in a document with at most k edits only if the region
around it shares at least ``(m - q + 1) - k q`` q-grams with it inside a band of diagonals: an
occurrence that starts near position d keeps its q-grams on diagonals d - k .. d + k. Bands of
width ``W = 2k + 1`` that overlap by half hold any such stretch whole, so counting shared q-grams per band loses
nothing. Bands that reach the bound are verified by an alignment restricted to them.

Both sides are compared in lower case with runs of white space as one blank; positions refer to
that form. ``EDIT_SHARE`` of m is the edit budget, less where the bound would fall below one shared
q-gram; a text shorter than q must occur literally.

The benchmark is looked up in blocks of at most ``BLOCK_CHARS`` characters (one longer text is a
block of its own): a block's index is what each task holds, and documents are read once per block.

Defined cases. Null or empty benchmark texts match nothing. Null document text: empty. Several
occurrences of a text in a document give the best one, the first of equal ones. Repeated rows give repeated results. Empty tables give no
rows. Other columns are ignored; ``keep_clean`` passes them through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import by_slice, filter_rows, id_and_text

Q = 12
EDIT_SHARE = 0.05
BLOCK_CHARS = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 22


def fold(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgram_keys(flat: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit key for each q-gram. Equal grams have equal keys; others are told apart by the alignment."""
    n = len(flat) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    letters = flat.astype(np.uint64)
    h = letters * _STEP
    h ^= h >> np.uint64(29)
    span = 1
    while span < q:  # keys of longer grams from two overlapping shorter ones
        step = min(span, q - span)
        h = h[:-step] * _STEP + h[step:]
        h ^= h >> np.uint64(31)
        span += step
    return h


def budget(m: int, q: int = Q, share: float = EDIT_SHARE) -> int:
    """Edits allowed for a text of m characters: the share, but at least one shared q-gram must be left."""
    return max(0, min(int(share * m), (m - q) // q))


class Index:
    """q-grams of one block of benchmark texts."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, share: float = EDIT_SHARE):
        self.q = q
        self.items = [(i, codes(fold(t or ""))) for i, t in items]
        self.strings = [fold(t or "") for _, t in items]
        self.short = [(n, s) for n, (_, s) in enumerate(self.items) if 0 < len(s) < q]
        self.k = np.array([budget(len(s), q, share) for _, s in self.items], np.int64)
        self.m = np.array([len(s) for _, s in self.items], np.int64)
        self.need = np.maximum(self.m - q + 1 - self.k * q, 1)
        keys = [qgram_keys(s, q) for _, s in self.items]
        owner = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        at = np.concatenate([np.arange(len(x)) for x in keys]) if keys else np.zeros(0, np.int64)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.owner, self.at = owner[order], at[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, flat: np.ndarray):
        """(document position, entry in ``keys``) of shared q-grams."""
        keys = qgram_keys(flat, self.q)
        maybe = np.flatnonzero(self.seen[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        entry = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
        good = self.keys[entry] == keys[maybe]
        return maybe[good], entry[good]

    def regions(self, flat: np.ndarray):
        """(item, first diagonal, last diagonal) of the bands that reach their item's bound."""
        pos, entry = self.hits(flat)
        if not len(pos):
            return []
        size = self.count[entry]
        which = np.repeat(np.arange(len(pos)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[entry], size)
        item, diagonal = self.owner[place], pos[which] - self.at[place]
        half = 2 * self.k[item] + 1
        band = (diagonal + self.m[item]) // half  # diagonals are above -m
        found: dict[tuple[int, int], int] = {}
        key = item << 40 | band
        # the two overlapping families of bands: cells (b, b+1)
        cells, counts = np.unique(key, return_counts=True)
        after = np.zeros(len(cells), np.int64)
        linked = np.flatnonzero(np.diff(cells) == 1)
        after[linked] = counts[linked + 1]
        own = cells >> 40
        enough = counts + after >= self.need[own]
        for cell in cells[enough]:
            n, b = int(cell >> 40), int(cell & ((1 << 40) - 1))
            width = int(2 * self.k[n] + 1)
            found[n, b] = b * width - int(self.m[n])
        out = []
        for (n, _), low in sorted(found.items()):
            high = low + 2 * int(2 * self.k[n] + 1) - 1
            if out and out[-1][0] == n and low <= out[-1][2] + 1:
                out[-1] = (n, out[-1][1], high)
            else:
                out.append((n, low, high))
        return out

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits): the best occurrence of each item within its budget."""
        folded = fold(text)
        flat = codes(folded)
        best: dict[int, tuple[int, int, int]] = {}
        for n, low, high in self.regions(flat):
            pattern = self.strings[n]  # a literal occurrence in the region needs no alignment
            at = folded.find(pattern, max(0, low), max(0, high) + len(pattern) + 1)
            if at >= 0:
                if n not in best or (0, at) < (best[n][2], best[n][0]):
                    best[n] = (at, at + len(pattern), 0)
            elif (hit := align(self.items[n][1], flat, low, high, int(self.k[n]))) and (n not in best or (hit[2], hit[0]) < (best[n][2], best[n][0])):
                best[n] = hit
        for n, s in self.short:
            at = folded.find(self.strings[n])
            if at >= 0:
                best[n] = (at, at + len(s), 0)
        return [(self.items[n][0], *hit) for n, hit in sorted(best.items())]


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, k: int):
    """Best placement of the whole pattern on diagonals low-k .. high+k: (start, end, edits) or None.

    A row per pattern letter over the band's diagonals; gaps along a row by a running minimum. Starts
    travel with the costs, the smaller edits win, then the earlier end.
    """
    low, high = low - k, high + k
    width, m = high - low + 1, len(pattern)
    offset = np.arange(width)
    place = low + offset  # text position before the first pattern letter
    inside = (place >= 0) & (place <= len(text))
    big = m + 1
    cost = np.where(inside, 0, big).astype(np.int64)
    start = place.copy()
    padded = np.concatenate([text.astype(np.int64), [-1]])
    for i in range(m):
        place = low + i + offset  # text letter compared on each diagonal
        ok = (place >= 0) & (place < len(text))
        same = np.where(ok, padded[np.clip(place, 0, len(text))] == pattern[i], False)
        step = np.where(ok, cost + ~same, big)
        skip = np.append(cost[1:] + 1, big)  # the pattern's letter is missing in the text
        take = skip < step
        new, from_ = np.where(take, skip, step), np.where(take, np.append(start[1:], 0), start)
        at = np.where((place + 1 >= 0) & (place + 1 <= len(text)), new, big) - offset  # extra letters in the text
        run = np.minimum.accumulate(at)
        source = np.maximum.accumulate(np.where(at == run, offset, 0))
        cost, start = run + offset, from_[source]
        if cost.min() > k:
            return None
    end = low + m + offset
    cost = np.where((end >= 0) & (end <= len(text)), cost, big)
    b = int(cost.argmin())
    return (int(start[b]), int(end[b]), int(cost[b])) if cost[b] <= k else None


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Yield the benchmark's texts in lists of bounded size; one list is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    held, size = [], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row.text) > block_chars:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield held


HITS = "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint"


def find_benchmark(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): benchmark texts found in documents."""
    spark, out = docs.sparkSession, None

    def search(shared):
        def make():
            index = Index(shared.value, q, share)

            def apply(batch):
                rows = [(d, *h) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for h in index.find(t)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

            return apply

        return by_slice(id_and_text(docs), make, HITS)

    for block in blocks(benchmark, block_chars):
        found = search(spark.sparkContext.broadcast(block))  # at most block_chars characters
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], HITS) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark text, with all their columns."""
    for block in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            index = Index(shared.value, q, share)
            return lambda batch: [not index.find(t or "") for t in batch.column("text").to_pylist()]

        docs = filter_rows(docs, make)
    return docs
