"""Suffix-array dedup: bytes of long strings that occur twice, by a hash-compared suffix sort.

Removed is every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else.
Strings never cross documents, and all are judged on the input.

1. Every string of ``LENGTH`` bytes picks one of its grams of ``GRAM`` bytes by smallest hash. Equal
   strings pick the same gram at the same place, so only strings with equal grams can be equal.
   Neighbouring strings mostly pick the same gram; such a run is an entry: gram hash, hash of all
   bytes of the run, document, place.
2. Entries whose gram occurs once are done: nothing equal. Entries that agree in gram and in all
   bytes are copies: all their strings are removed, at once, whatever their number.
3. For grams with several different runs the bytes are fetched, once for each different run. The
   strings of these runs are suffixes cut to ``LENGTH``; suffixes that stand alike to an equal gram
   are sorted by mergesort. A comparison finds the common extension by binary search on prefix
   polynomial hashes, in logarithmic time; neighbours that agree over ``LENGTH`` bytes are equal,
   which is verified on the bytes, since hashes can collide.
4. Runs with very many partners are cut out of step 3: their strings are grouped as whole byte
   strings, each a key of its own, so that no task holds such a group.

Hashes of step 2 have 64 bits for the gram and 64 for the run: two runs would have to collide in
both to be taken for copies.

Defined cases. Null text: empty. Texts shorter than ``LENGTH`` bytes are kept. Repeated rows are
copies of each other. A null doc_id is an id like any other. Empty table: no rows. Other columns
are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytehash import picked, prefix_hashes, slices
from millrace.llm.common import by_slice, id_and_text
from millrace.session import materialize

LENGTH = 200
GRAM = 32
CROWD = 4096  # different runs of one gram; above, its strings are grouped by Spark one by one
STRINGS = 500_000  # suffixes sorted together in a task, unless one gram has more

KEY = "doc_key bigint, doc_check int"


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_key, doc_check, doc_id, text): 96 bits of hash over id and text name a document.

    Rows equal in both are copies and share all results, so they can share a key.
    """
    rows = id_and_text(docs)
    ident = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))
    return rows.select(F.xxhash64(ident).alias("doc_key"), F.hash(ident).alias("doc_check"), "doc_id", "text")


def _unsigned(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def entries(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(gram, run, doc_key, doc_check, first, n, at): runs of strings that pick the same gram."""

    def make():
        def apply(batch):
            out: list[list[np.ndarray]] = []
            owners, sizes = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) < length:
                    continue
                prefix = prefix_hashes(data)
                first, last, at = picked(prefix, gram, length)
                out.append([slices(prefix, at, gram), slices(prefix, first, last - first + length), first, last - first + 1, at - first])
                owners.append(row)
                sizes.append(len(first))
            if not out:
                return None
            g, r, first, n, at = (np.concatenate(c) for c in zip(*out, strict=True))
            row = pa.array(np.repeat(owners, sizes))
            columns = [_unsigned(g), _unsigned(r), batch.column("doc_key").take(row), batch.column("doc_check").take(row)]
            columns += [pa.array(c.astype(np.int32)) for c in (first, n, at)]
            return pa.RecordBatch.from_arrays(columns, names=["gram", "run", "doc_key", "doc_check", "first", "n", "at"])

        return apply

    return by_slice(keyed, make, f"gram bigint, run bigint, {KEY}, first int, n int, at int")


# --- the suffix sort ---------------------------------------------------------------------------


class Suffixes:
    """Suffixes of ``length`` bytes in one buffer, compared by their common extension."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = prefix_hashes(data)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension at places ``a`` and ``b``, at most ``length``."""
        low = np.zeros(len(a), np.int64)
        equal = slices(self.prefix, a, self.length) == slices(self.prefix, b, self.length)
        low[equal] = self.length
        todo = np.flatnonzero(~equal)
        a, b = a[todo], b[todo]
        lo, hi = np.zeros(len(todo), np.int64), np.full(len(todo), self.length - 1)
        while len(todo) and (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = slices(self.prefix, a, mid) == slices(self.prefix, b, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        low[todo] = lo
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair: the byte behind the common extension decides."""
        common = self.extension(a, b)
        inside = common < self.length
        at = np.minimum(common, self.length - 1)
        x, y = self.data[a + at].astype(np.int16), self.data[b + at].astype(np.int16)
        return np.where(inside, np.sign(x - y), 0)

    def sort(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups (``group`` ascends): a mergesort of all groups at once.

        Each round merges neighbouring runs; an element's place is its own rank and its rank in the
        other run, found by binary search.
        """
        order = np.arange(len(places))
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(begin, len(places)))
        start, within = np.repeat(begin, size), np.arange(len(places)) - np.repeat(begin, size)
        stop = start + np.repeat(size, size)
        run = 1
        while run < size.max(initial=0):
            mine = within // run
            other = np.where(mine % 2 == 0, mine + 1, mine - 1)
            lo = np.minimum(start + other * run, stop)
            hi = np.minimum(lo + run, stop)
            moving = np.flatnonzero(hi > lo)
            base, low, high = lo[moving], lo[moving].copy(), hi[moving].copy()
            second = mine[moving] % 2 == 1  # ties: the first run's elements come first
            own = places[order[moving]]
            live = np.arange(len(moving))
            while len(live):
                mid = (low[live] + high[live]) // 2
                sign = self.less(places[order[mid]], own[live])
                before = (sign < 0) | ((sign == 0) & second[live])
                low[live] = np.where(before, mid + 1, low[live])
                high[live] = np.where(before, high[live], mid)
                live = live[low[live] < high[live]]
            pair = start + (mine // 2) * 2 * run
            target = np.arange(len(places))
            target[moving] = pair[moving] + (within[moving] - mine[moving] * run) + (low - base)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            run *= 2
        return order

    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes are equal byte for byte."""
        out, span = np.zeros(len(a), bool), np.arange(self.length)
        for at in range(0, len(a), 50_000):
            x, y = a[at : at + 50_000, None] + span, b[at : at + 50_000, None] + span
            out[at : at + 50_000] = (self.data[x] == self.data[y]).all(axis=1)
        return out

    def repeated(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which suffixes equal another one of their group; ``group`` ascends."""
        twice = np.zeros(len(places), bool)
        # unequal hashes prove unequal suffixes: only those with a partner are sorted
        whole = slices(self.prefix, places, self.length)
        near = np.lexsort((whole, group))
        alike = (whole[near][1:] == whole[near][:-1]) & (group[near][1:] == group[near][:-1])
        keep = np.zeros(len(places), bool)
        keep[near[1:][alike]] = True
        keep[near[:-1][alike]] = True
        chosen = np.flatnonzero(keep)
        if not len(chosen):
            return twice
        order = chosen[self.sort(places[chosen], group[chosen])]
        a, b = order[:-1], order[1:]
        touch = np.flatnonzero(group[a] == group[b])
        touch = touch[self.extension(places[a[touch]], places[b[touch]]) >= self.length]
        good = self.same_bytes(places[a[touch]], places[b[touch]])
        twice[a[touch[good]]] = True
        twice[b[touch[good]]] = True
        if not good.all():  # a collision: those groups again, by their bytes
            for g in np.unique(group[a[touch[~good]]]):
                members = np.flatnonzero(group == g)
                seen: dict[bytes, int] = {}
                for m in members.tolist():
                    s = self.data[places[m] : places[m] + self.length].tobytes()
                    if s in seen:
                        twice[m] = twice[seen[s]] = True
                    seen.setdefault(s, m)
        return twice


def repeated_strings(gram: np.ndarray, first_place: np.ndarray, n: np.ndarray, at: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, string) of the strings of entries that equal one of another entry of their gram.

    ``gram`` ascends. String j of an entry starts at ``first_place + j`` of ``data`` and its gram
    ``at - j`` bytes behind that; only strings with the gram at the same place can be equal.
    """
    owner = np.repeat(np.arange(len(n)), n)
    j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    number = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])))
    group = number[owner] * (length + 1) + (at[owner] - j)
    order = np.argsort(group, kind="stable")
    owner, j, group = owner[order], j[order], group[order]
    twice = Suffixes(data, length).repeated(first_place[owner] + j, group)
    return owner[twice], j[twice]


# --- in Spark ------------------------------------------------------------------------------------


def _packed(keyed: DataFrame) -> DataFrame:
    """(doc_key, doc_check, doc_id, packed): texts compressed for the way through a shuffle."""

    def make():
        pack = zstandard.ZstdCompressor(level=3).compress

        def apply(batch):
            packed = pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()], pa.binary())
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_key", "doc_check", "doc_id")), packed], names=["doc_key", "doc_check", "doc_id", "packed"])

        return apply

    return by_slice(keyed, make, f"{KEY}, doc_id bigint, packed binary")


def _runs_bytes(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, lone, doc_key, doc_check, first, n, at, bytes) of the wanted entries."""
    lists = wanted.groupBy("doc_key", "doc_check").agg(F.collect_list(F.struct("gram", "lone", "first", "n", "at")).alias("wanted"))
    joined = _packed(keyed).join(lists, ["doc_key", "doc_check"]).select("doc_key", "doc_check", "packed", "wanted")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for key, check, packed, wanted_ in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    text = unpack(packed)
                    rows += [(w["gram"], w["lone"], key, check, w["first"], w["n"], w["at"], text[w["first"] : w["first"] + w["n"] + length - 1]) for w in wanted_]
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "lone", "doc_key", "doc_check", "first", "n", "at", "bytes"])

    return joined.mapInArrow(run, f"gram bigint, lone boolean, {KEY}, first int, n int, at int, bytes binary")


SPANS = f"{KEY}, start int, stop int"


def _sorted_strings(runs: DataFrame, length: int) -> DataFrame:
    """(doc_key, doc_check, start, stop): starts of repeated strings of the lone runs, by the suffix sort."""
    dealt = runs.repartition("gram").sortWithinPartitions("gram")

    def solve(batches):
        table = pa.Table.from_batches(batches)
        columns = {c: np.asarray(table.column(c)) for c in ("gram", "first", "n", "at", "doc_key", "doc_check", "lone")}
        pieces = table.column("bytes").to_pylist()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = columns["n"].astype(np.int64)
        entry, j = repeated_strings(columns["gram"], np.cumsum(sizes) - sizes, n, columns["at"].astype(np.int64), data, length)
        lone = columns["lone"][entry]
        entry, j = entry[lone], j[lone]  # copies are removed already
        order = np.lexsort((j, entry))
        entry, j = entry[order], j[order]
        cut = np.flatnonzero((entry[1:] != entry[:-1]) | (j[1:] != j[:-1] + 1))
        low, high = np.concatenate(([0], cut + 1))[: len(entry)], np.concatenate((cut, [len(entry) - 1]))[: len(entry)]
        e = entry[low]
        first = columns["first"][e]
        out = [columns["doc_key"][e], columns["doc_check"][e], first + j[low], first + j[high] + 1]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_key", "doc_check", "start", "stop"])

    def run(batches):
        held, strings = [], 0
        for batch in batches:
            grams = np.asarray(batch.column("gram"))
            cuts = [0, *(np.flatnonzero(grams[1:] != grams[:-1]) + 1).tolist(), batch.num_rows]
            counts = np.concatenate(([0], np.cumsum(np.asarray(batch.column("n")))))
            last = held[-1].column("gram")[held[-1].num_rows - 1].as_py() if held else None
            begin = 0
            for low, high in itertools.pairwise(cuts):
                if low == high:
                    continue
                if strings + counts[low] - counts[begin] > STRINGS and grams[low] != last:
                    if low > begin:
                        held.append(batch.slice(begin, low - begin))
                    if held:
                        yield solve(held)
                    held, strings, begin = [], 0, low
                last = grams[low]
            held.append(batch.slice(begin))
            strings += int(counts[-1] - counts[begin])
        if held:
            yield solve(held)

    return dealt.mapInArrow(run, SPANS)


def _grouped_strings(runs: DataFrame, length: int) -> DataFrame:
    """The same for crowded grams: every string is a group of its own, so no task holds a gram.
    """
    place = F.col("at") - F.col("j")  # of the gram in the string
    rows = runs.select("*", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos", "j")).drop("pos")
    rows = rows.withColumn("place", place)
    string = F.substring(F.col("bytes"), F.col("j") + 1, F.lit(length))
    rows = rows.select("gram", "place", "lone", "doc_key", "doc_check", (F.col("first") + F.col("j")).alias("start"), string.alias("string"))
    counted = rows.groupBy("gram", "place", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = rows.where("lone").join(counted, ["gram", "place", "string"], "left_semi")
    return again.select("doc_key", "doc_check", F.col("start").cast("int").alias("start"), (F.col("start") + 1).cast("int").alias("stop"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_key, doc_check, starts): runs [start, stop) of starts of repeated strings per document."""
    every = materialize(entries(keyed, length, gram), "entries")
    twice = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    common = materialize(every.join(twice, "gram", "left_semi"), "common-entries")
    at = F.struct("doc_key", "doc_check", "first", "n", "at")
    kinds = common.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("copies"), F.min(at).alias("sample"))
    kinds = materialize(kinds, "runs")
    copies = kinds.where("copies > 1").select("gram", "run")
    whole = common.join(copies, ["gram", "run"], "left_semi")
    whole = whole.select("doc_key", "doc_check", F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("stop"))
    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("fewest"))
    open_ = several.where("kinds > 1 and fewest = 1").select("gram", "kinds")  # else all are copies
    wanted = kinds.join(open_, "gram").select("gram", "kinds", (F.col("copies") == 1).alias("lone"), "sample.*")
    crowded = wanted.where(F.col("kinds") > crowd).select("gram").distinct()
    runs = materialize(_runs_bytes(keyed, wanted, length), "run-bytes")
    few = runs.join(crowded, "gram", "left_anti")
    many = runs.join(crowded, "gram", "left_semi")
    spans = whole.unionByName(_sorted_strings(few, length)).unionByName(_grouped_strings(many, length))
    return spans.groupBy("doc_key", "doc_check").agg(F.collect_list(F.struct("start", "stop")).alias("starts"))


def covered(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings that start in the given runs."""
    out: list[list[int]] = []
    for start, stop in sorted(starts):
        end = stop - 1 + length
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def cut_documents(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, kept, removed): remaining bytes and the removed byte spans of every document."""
    keyed = _keyed(docs)
    spans = materialize(repeated_spans(keyed, length, gram, crowd), "repeated-spans")
    joined = _packed(keyed).join(spans, ["doc_key", "doc_check"], "left").select("doc_id", "packed", "starts")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                kept, removed = [], []
                for packed, starts in zip(part.column("packed").to_pylist(), part.column("starts").to_pylist(), strict=True):
                    text = unpack(packed)
                    gone = covered([(s["start"], s["stop"]) for s in starts], length) if starts else []
                    edges = [0, *itertools.chain.from_iterable(gone), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in itertools.batched(edges, 2)))
                    removed.append([{"start": a, "stop": b} for a, b in gone])
                spans_ = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.binary()), spans_], names=["doc_id", "kept", "removed"])

    return joined.mapInArrow(run, "doc_id bigint, kept binary, removed array<struct<start: bigint, stop: bigint>>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and runs, digest of what is left."""
    rows = cut_documents(docs)
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r.stop - r.start)
    left = F.octet_length("kept").cast("bigint")
    return rows.select(
        "doc_id", (left + gone).alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
