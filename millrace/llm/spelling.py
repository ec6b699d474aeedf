"""Spelling variants: words within one edit of each other, found by a bidirectional FM-index.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code point
separates them. Search scheme for one error and two halves: a word's first half is matched exactly and
then extended to the right over the second half with one error allowed, or its second half is matched
exactly and extended to the left over the first. One of the two finds every near word.

The index is over the delimited vocabulary ``#word#word#...``. A state is a pair of intervals of suffix
ranks, one in the text's index and one in that of the reversed text; a step to the right narrows the
interval of the reversed text by its Burrows-Wheeler transform and moves the other one by the number of
smaller symbols, a step to the left does the opposite. ``Direction`` holds one transform as a wavelet
matrix, which answers "how many of this symbol, how many smaller" in one descent and lists the symbols
that occur in an interval. A state that has matched ``#word#`` is an interval of one rank, the word's.

In Spark. Near words share the exact half, so words meet in shards by the hash of their halves: one kind
of shard for first halves, searched to the right, and one for second halves, searched to the left. A pair
is reported in the one shard of the half it shares (the first one if both kinds find it), so counts of
shards add up. A shard of more than twice ``PIECE`` symbols is cut into pieces; every piece is an index that the
words of all pieces are searched in, each combination in a task of bounded memory. No pairs of words are
formed other than near ones, and those leave a task as a count and the best word.

Defined cases. A null text has no words; with a null doc_id no code point is deleted. Repeated rows count
again. Words of any length and any code points may be searched. An empty table or one without repeated
words gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

RUN = "[A-Za-zÀ-ÿ]"
TYPO_EVERY = 31  # a run whose hash this divides loses a code point
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
PIECE = 500_000  # symbols of an ordinary index; none has more than twice as many
BATCH = 8192  # words searched at a time

FIRST, SECOND = 0, 1  # the half that is matched exactly


# --- the index ---------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Positions of a delimited text (delimiter 0) in the order of what follows up to the next delimiter.

    Equal ones keep their order in the text, which is that of the words behind them if these are sorted.
    """
    n = len(symbols)
    here = np.arange(n)
    stop = np.where(symbols == 0, here, n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]  # the next delimiter
    rank, width = symbols.astype(np.int64), 1
    while width <= longest:
        key = rank * (n + 1) + rank[np.minimum(here + width, stop)]
        order = np.argsort(key, kind="stable")
        steps = np.empty(n, np.int64)
        steps[0] = 0
        steps[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(steps)
        width *= 2
    return np.argsort(rank, kind="stable")


class Direction:
    """The Burrows-Wheeler transform of a delimited text as a wavelet matrix; steps go to the left."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, size: int):
        """``flat``: symbols 1 to ``size`` of the words in sorted order; ``lengths``: theirs."""
        self.words, self.size = len(lengths), size
        text = np.zeros(len(flat) + len(lengths) + 1, np.int32)
        text[np.arange(len(flat)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = flat
        order = suffix_order(text, int(lengths.max(initial=0)) + 1)
        # before the first delimiter stands a symbol of its own, larger than all; size + 2 is never there
        row = np.where(order == 0, size + 1, text[order - 1])
        counts = np.bincount(text, minlength=size + 3)
        self.before = np.cumsum(counts) - counts
        self.bits = int(size + 2).bit_length()
        self.zeros, start = [], np.zeros(size + 3, np.int64)
        symbols = np.arange(size + 3)
        for level in range(self.bits - 1, -1, -1):
            one = (row >> level) & 1 == 1
            zeros = np.zeros(len(row) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.zeros.append(zeros)
            high = (symbols >> level) & 1 == 1
            start = np.where(high, zeros[-1] + start - zeros[start], zeros[start])
            row = np.concatenate([row[~one], row[one]])
        self.shift = self.before - start  # from a place in the last level to a suffix rank

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """(low, high, smaller) of the intervals after one more symbol; smaller symbols are counted."""
        smaller = np.zeros(len(low), np.int64)
        for zeros, level in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = (symbol >> level) & 1 == 1
            a, b = zeros[low], zeros[high]
            smaller += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        shift = self.shift[symbol]
        return low + shift, high + shift, smaller

    def branches(self, low: np.ndarray, high: np.ndarray):
        """(state, symbol, low, high, smaller) for every word symbol that occurs in the intervals."""
        state, symbol, smaller = np.arange(len(low)), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        for zeros, level in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            a, b = zeros[low], zeros[high]
            c, d = zeros[-1] + low - a, zeros[-1] + high - b
            left, right = np.flatnonzero(b > a), np.flatnonzero(d > c)
            smaller = np.concatenate([smaller[left], smaller[right] + (b - a)[right]])
            symbol = np.concatenate([symbol[left], symbol[right] | (1 << level)])
            state = np.concatenate([state[left], state[right]])
            low, high = np.concatenate([a[left], c[right]]), np.concatenate([b[left], d[right]])
        good = (symbol > 0) & (symbol <= self.size)
        state, symbol, low, high, smaller = (x[good] for x in (state, symbol, low, high, smaller))
        shift = self.shift[symbol]
        return state, symbol, low + shift, high + shift, smaller


def _flat(words: list[str], alphabet: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets, lengths) of words, each read backwards if asked; symbols unknown get the last number."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(w[::-1] for w in words).encode("utf-32-le") if backwards else "".join(words).encode("utf-32-le"), np.uint32)
    place = np.minimum(np.searchsorted(alphabet, points), max(len(alphabet) - 1, 0))
    known = alphabet[place] == points if len(alphabet) else np.zeros(len(points), bool)
    return np.where(known, place + 1, len(alphabet) + 2).astype(np.int64), np.cumsum(lengths) - lengths, lengths


def near_words(index: list[str], queries: list[str], half: int):
    """Yield (query, rank): places of near words in the sorted ``index``, by one of the two searches."""
    alphabet = np.unique(np.frombuffer("".join(index).encode("utf-32-le"), np.uint32))
    to_right = half == FIRST
    # a step to the right is one to the left in the reversed text
    ordered = sorted(w[::-1] for w in index) if to_right else index
    symbols, _, lengths = _flat(ordered, alphabet, False)
    text = Direction(symbols, lengths, len(alphabet))
    flat, offset, length = _flat(queries, alphabet, not to_right)
    flat = np.append(flat, len(alphabet) + 2)
    exact = (length - 1) // 2 if to_right else length // 2
    for first in range(0, len(queries), BATCH):
        q = np.arange(first, min(first + BATCH, len(queries)))
        # after the delimiter on the side of the exact half: the interval in the index that is searched,
        # the interval of the other one, their size, how much is read, and whether the error is spent
        low, other, high = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), len(index) + 1)
        at, spent = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        while len(q):
            ended = at == length[q]
            over = np.flatnonzero(ended & spent)
            if len(over):
                a, b, smaller = text.step(np.zeros(len(over), np.int64), low[over], high[over])
                hit = b > a
                # the interval of the text itself holds the word's rank: the moved one on a search to the
                # right; the last delimiter goes to the left otherwise
                yield q[over][hit], ((other[over] + smaller) if to_right else a)[hit]
            wanted = flat[offset[q] + np.minimum(at, length[q] - 1)]
            plain = np.flatnonzero(~ended & (spent | (at < exact[q])))
            a, b, smaller = text.step(wanted[plain], low[plain], high[plain])
            live = b > a
            keep = plain[live]
            out = [(q[keep], at[keep] + 1, spent[keep], a[live], b[live], (other[plain] + smaller)[live])]
            free = np.flatnonzero(~spent & (at >= exact[q]))
            if len(free):
                s, symbol, a, b, smaller = text.branches(low[free], high[free])
                s = free[s]
                same = (symbol == wanted[s]) & ~ended[s]
                moved = other[s] + smaller
                for chosen, forward, error in ((same, 1, False), (~same & ~ended[s], 1, True), (~same, 0, True)):
                    t = s[chosen]
                    out.append((q[t], at[t] + forward, np.full(len(t), error), a[chosen], b[chosen], moved[chosen]))
                # one of the word's own symbols is left out: of a run of equal ones the last
                following = flat[offset[q[free]] + np.minimum(at[free] + 1, length[q[free]] - 1)]
                last = at[free] + 1 >= length[q[free]]
                t = free[~ended[free] & (last | (following != wanted[free]))]
                out.append((q[t], at[t] + 1, np.ones(len(t), bool), low[t], high[t], other[t]))
            q, at, spent, low, high, other = (np.concatenate(x) for x in zip(*out, strict=True))


def _half(word: str, shorter: int, half: int) -> str:
    """What a word shares with a near one, the shorter of both having ``shorter`` code points."""
    return word[: shorter // 2] if half == FIRST else word[len(word) - (shorter - shorter // 2) :]


def _shard_of(key: str, shards: int) -> int:
    return zlib.crc32(key.encode("utf-8")) % shards


def search_shard(words: pa.Table, half: int, shard: int, shards: int) -> pa.Table:
    """(word, n, n_near, best_n, best) of the words to search, counted where this shard reports the pair."""
    columns = {c: words.column(c).to_pylist() for c in ("word", "n", "is_index", "is_query")}
    rows = sorted(zip(*columns.values(), strict=True))
    index = [(w, n) for w, n, i, _ in rows if i]
    asked = [(w, n) for w, n, _, q in rows if q]
    names, queries = [w for w, _ in index], [w for w, _ in asked]
    counts = np.array([n for _, n in index], np.int64)
    sizes = [np.array([len(w) for w in x], np.int64) for x in (queries, names)]
    numbers: dict[str, int] = {}
    # first halves as numbers, for a near word that is shorter (0) and for others (1)
    firsts = [[np.array([numbers.setdefault(w[: (len(w) - d) // 2], len(numbers)) for w in x], np.int64) for d in (1, 0)] for x in (queries, names)]
    mine = [np.array([_shard_of(_half(w, len(w) - d, half), shards) == shard for w in queries], bool) for d in (1, 0)]
    n_near = np.zeros(len(queries), np.int64)
    best_n, best = np.zeros(len(queries), np.int64), np.full(len(queries), -1)
    for q, k in near_words(names, queries, half) if names else ():
        change = sizes[1][k] - sizes[0][q]
        in_first = np.where(change < 0, firsts[0][0][q], firsts[0][1][q]) == np.where(change > 0, firsts[1][0][k], firsts[1][1][k])
        good = np.where(change < 0, mine[0][q], mine[1][q]) & (in_first if half == FIRST else ~in_first)
        q, k = q[good], k[good]
        np.add.at(n_near, q, 1)
        order = np.lexsort((k, -counts[k], q))
        q, k = q[order], k[order]
        top = np.ones(len(q), bool)
        top[1:] = q[1:] != q[:-1]
        q, k = q[top], k[top]
        better = (counts[k] > best_n[q]) | ((counts[k] == best_n[q]) & (k < best[q]))
        best_n[q[better]], best[q[better]] = counts[k[better]], k[better]
    return pa.table(
        {
            "word": pa.array(queries, pa.string()),
            "n": pa.array([n for _, n in asked], pa.int64()),
            "n_near": pa.array(n_near),
            "best_n": pa.array(best_n, mask=best < 0),
            "best": pa.array([names[b] if b >= 0 else None for b in best.tolist()], pa.string()),
        }
    )


# --- in Spark ----------------------------------------------------------------------------------


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, some with a code point deleted by their hash."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({RUN}{{{min_length},}})"), 1)
    found = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", upper, lower).alias("run"))
    found = found.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    place = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, p)"), F.expr("substring(run, p + 2)"))
    words = found.withColumn("p", place).select(F.when(F.col("h") % typo_every == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def near_counts(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) for every row of (word, n), whose words are distinct."""
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    shards = max(1, -(-4 * total // PIECE))  # a word is in up to two shards of either kind
    size = F.length("word")

    def key(half: int, shorter):
        part = F.floor(shorter / 2).cast("int")
        text = F.substring("word", F.lit(1), part) if half == FIRST else F.substring("word", size - (shorter - part) + 1, size)
        shard = F.crc32(F.encode(text, "UTF-8")) % shards
        return F.struct(F.lit(half).alias("half"), shard.cast("int").alias("shard"))

    places = F.array_distinct(F.array(*[key(half, size - d) for half in (FIRST, SECOND) for d in (1, 0)]))
    rows = words.select("word", "n", F.explode(places).alias("place")).select("word", "n", "place.half", "place.shard")
    sums = rows.groupBy("half", "shard").agg(F.ceil(F.sum(F.length("word") + 1) / (2 * PIECE)).cast("int").alias("pieces"))
    cut = rows.join(materialize(sums, "shards"), ["half", "shard"])  # a row per shard: PIECE symbols of vocabulary each
    piece = F.pmod(F.crc32(F.encode(F.concat("word", F.lit("/piece")), "UTF-8")), F.col("pieces")).cast("int")
    each = F.sequence(F.lit(0), F.col("pieces") - 1)
    as_index = F.transform(each, lambda o: F.struct(F.col("piece").alias("a"), o.alias("b"), F.lit(True).alias("is_index"), (o == F.col("piece")).alias("is_query")))
    as_query = F.transform(
        F.filter(each, lambda o: o != F.col("piece")),
        lambda o: F.struct(o.alias("a"), F.col("piece").alias("b"), F.lit(False).alias("is_index"), F.lit(True).alias("is_query")),
    )
    dealt = cut.withColumn("piece", piece).select("word", "n", "half", "shard", F.explode(F.concat(as_index, as_query)).alias("r")).select("word", "n", "half", "shard", "r.*")

    def search(group, table):
        return search_shard(table, group[0].as_py(), group[1].as_py(), shards)

    found = dealt.groupBy("half", "shard", "a", "b").applyInArrow(search, "word string, n bigint, n_near bigint, best_n bigint, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("first")
    added = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best)
    return added.select("word", "n", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the usual form of each word, and the last one from there.

    A form is at least ``ratio`` times as frequent, so chains are as short as the logarithm of the largest
    count; each round doubles the part that is followed.
    """
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = near_counts(words).select(
        "word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    found = materialize(found, "forms")
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    joined = found.join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The contract's columns for all words of ``docs``."""
    return variants(materialize(vocabulary(docs), "vocabulary"))
