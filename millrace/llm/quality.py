"""Quality rules: base counts and an n-gram perplexity within bands of the text's language.

The model is an interpolated modified Kneser-Ney model over the characters of words (a word begins
with ``^`` and ends with ``$``), counted over all documents in Spark, one per language. Its
probabilities and back-off weights are stored in sorted hash arrays; a word is scored once per task
and remembered. A document that is far less likely than its language's corpus as a whole may be written
in several languages: each of its words is then scored by the language it fits best. A document's perplexity is per character; a language's documents give robust bands
(median and median deviation of the logarithm), and a document outside its language's bands goes.

The model keeps every n-gram of the corpus and grows with it. Those seen at least ``total / MAX_GRAMS``
times per language and order, at most ``MAX_GRAMS`` of them by that rule, are broadcast; all rarer ones
lie in the shared folder in blocks sorted by hash, and a task reads the blocks it needs and holds
``HELD_BLOCKS`` of them. Where an n-gram lies has no effect on scores. ``LANGUAGES`` most frequent
languages have models; the texts of all others train and use one they share (``""``).

Defined cases. Null text: empty, no words, base_failed. Null language: the shared model. A language
with fewer than ``MIN_DOCS`` documents has no bands and rejects nothing. Repeated rows count as
rows and get equal verdicts. An empty table gives no rows. Clashing columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from millrace.llm.common import by_slice, file_system, free_name, map_by_place, quoted, slices_of
from millrace.session import materialize, scratch_path

ORDER = 4
MAX_GRAMS = 1 << 18  # broadcast, 16 bytes each: at most 4 MB per language and order, 151 MB in all
BLOCK_GRAMS = 1 << 16  # rarer n-grams per block, 1 MB
HELD_BLOCKS = 32  # blocks a task holds at a time
LANGUAGES = 8
MIN_WORDS = 50
MIN_DOCS = 30
# Bands in median deviations of the logarithm, and at least so many natural logarithms wide. Clean
# texts scatter more upwards (names, numbers, quotations) than downwards (runs of stock phrases).
UPPER_BAND, LEAST_UPPER = 20.0, 0.5
LOWER_BAND, LEAST_LOWER = 10.0, 0.1
MIXED = 0.25  # nats a letter above its language's corpus from which a text is scored in all languages
HELD = 100_000  # distinct n-grams or words a task holds before it hands them on
SYMBOLS = "#*$%&|<>"


# --- base rules ------------------------------------------------------------------------------

_BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: str) -> list[str]:
    """Words between ASCII blanks only (str.split would split at other white space too)."""
    return text.translate(_OTHER_BLANKS).split(" ") if not _plain(text) else text.split()


_OTHER_BLANKS = {ord(c): " " for c in _BLANKS}
_UNICODE_BLANKS = frozenset(c for c in map(chr, range(0x110000)) if c.isspace()) - frozenset(_BLANKS)


def _plain(text: str) -> bool:
    return text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or _UNICODE_BLANKS.isdisjoint(text)


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = len(number)
    if size == n:
        return 0
    pairs = ids[:-1] * size + ids[1:]
    if size >= 1 << 21:  # keeps the combined number below 2**63
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * size + ids[2:]
    order = np.argsort(triples, kind="stable")
    same = triples[order][1:] == triples[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def base_counts(text: str, words: list[str]) -> dict:
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += bool(line.strip(_BLANKS))
        else:
            seen.add(line)
    n, repeats = len(words), repeated_words(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": again,
        "n_repeat_words": repeats,
        "base_failed": n < MIN_WORDS or 100 * repeats > 50 * n,
    }


# --- the model -------------------------------------------------------------------------------


def languages(docs: DataFrame, limit: int = LANGUAGES) -> list[str]:
    """The languages that get a model of their own: at most ``limit`` names."""
    named = docs.where(F.col("lang").isNotNull() & (F.col("lang") != ""))
    top = named.groupBy(F.col("lang").cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(limit)
    return sorted(r.lang for r in top.collect())


def _inputs(docs: DataFrame, langs: list[str]) -> DataFrame:
    lang = F.col("lang").cast("string")
    own = F.when(lang.isin(langs), lang).otherwise(F.lit("")) if langs else F.lit("")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), own.alias("lang")
    )


def gram_counts(inputs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): all n-grams of the highest order and word beginnings, summed per task first."""

    def run(batches):
        words: dict[str, Counter] = {}

        def flush():
            rows = Counter()
            for lang, counted in words.items():
                for word, n in counted.items():
                    marked = f"^{word}$"
                    for end in range(2, len(marked) + 1):
                        rows[lang, marked[max(0, end - order) : end]] += n
            words.clear()
            langs, grams = zip(*rows, strict=True) if rows else ((), ())
            columns = [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(rows.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

        for batch in batches:
            for part in slices_of(batch):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, words.values())) > HELD:
                    yield flush()
        yield flush()

    counted = inputs.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n, p, bow) of an interpolated modified Kneser-Ney model, from (lang, gram, n).

    Grams shorter than ``order`` in the input begin a word and keep their own counts; all others
    get the number of different letters seen before them. Discounts come from the counts of
    counts of each order and language.
    """
    table = {order: counts.where(F.length("gram") == order)}
    opening = counts.where(F.length("gram") < order)
    for k in range(order - 1, 0, -1):
        tail = table[k + 1].select("lang", F.substring("gram", 2, k).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
        begins = opening.where(F.length("gram") == k)
        table[k] = materialize(tail.unionByName(begins).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"counts-{k}")
    lower, probable, weights = None, {}, {}
    for k in range(1, order + 1):
        grams, of = table[k], F.col("n")
        stats = grams.groupBy("lang").agg(
            *[F.sum((of == c).cast("double")).alias(f"n{c}") for c in (1, 2, 3, 4)], F.count(F.lit(1)).alias("letters")
        )
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        d = {}
        for c in (1, 2, 3):  # Chen and Goodman's estimates; half a count where a count of counts is zero
            estimate = c - (c + 1) * y * F.try_divide(F.col(f"n{c + 1}"), F.col(f"n{c}"))
            d[c] = F.when(estimate.isNull(), 0.5).otherwise(F.least(F.greatest(estimate, F.lit(0.1)), F.lit(c - 0.1)))
        discounts = stats.select("lang", "letters", *[d[c].alias(f"d{c}") for c in (1, 2, 3)])
        cut = F.when(of == 1, F.col("d1")).when(of == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = grams.join(F.broadcast(discounts), "lang")  # one row per language: at most LANGUAGES + 1
        rows = rows.withColumns({"context": F.substring("gram", 1, k - 1), "cut": cut})
        sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"), F.first("letters").alias("letters"))
        sums = materialize(sums, f"contexts-{k}")
        weights[k - 1] = sums.select("lang", F.col("context").alias("gram"), (F.col("freed") / F.col("total")).alias("bow"))
        rows = rows.drop("letters").join(sums, ["lang", "context"])
        own = (F.col("n") - F.col("cut")) / F.col("total")
        if lower is None:
            uniform = F.col("freed") / F.col("total") / (F.col("letters") + 1)
            rows = rows.select("lang", "gram", "n", (own + uniform).alias("p"))
            probable[0] = sums.select("lang", F.lit("").alias("gram"), F.col("total").alias("n"), uniform.alias("p"))
        else:
            shorter = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("low"))
            rows = rows.withColumn("tail", F.substring("gram", 2, k - 1)).join(shorter, ["lang", "tail"])
            rows = rows.select("lang", "gram", "n", (own + F.col("freed") / F.col("total") * F.col("low")).alias("p"))
        probable[k] = lower = materialize(rows, f"order-{k}")
    kept = None
    for k, rows in probable.items():
        rows = rows.join(weights[k], ["lang", "gram"], "left") if 0 < k < order else rows.withColumn("bow", F.lit(1.0))
        kept = rows if kept is None else kept.unionByName(rows)
    return kept.select("lang", "gram", "n", F.col("p").cast("float").alias("p"), F.coalesce("bow", F.lit(1.0)).cast("float").alias("bow"))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all marked words in a row, and where each begins."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return flat, np.cumsum([0, *map(len, words)])


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _push(h, letters):
    h = (h ^ letters) * _STEP
    return h ^ (h >> np.uint64(32))


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _hashed(rows: pa.Table | pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, log probabilities and log back-off weights of the n-grams of ``k`` letters in ``rows``."""
    import pyarrow.compute as pc

    part = rows.filter(pc.equal(pc.utf8_length(rows.column("gram")), k))
    langs = part.column("lang").to_pylist()
    seeds = {lang: _seed(lang) for lang in set(langs)}
    keys = np.array([seeds[lang] for lang in langs], np.uint64)
    flat, _ = _codes(part.column("gram").to_pylist())
    for j in range(k):
        keys = _push(keys, flat[j::k])
    p, bow = (np.asarray(part.column(c)).astype(np.float64) for c in ("p", "bow"))
    return keys, np.log(p).astype(np.float32), np.log(np.maximum(bow, 1e-9)).astype(np.float32)


def _find_keys(table: np.ndarray, p: np.ndarray, bow: np.ndarray, keys: np.ndarray):
    """Whether each key is in a sorted array, and its two values."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, p[at], bow[at]


class RareGrams:
    """Sorted hash arrays in the shared folder, one Parquet file per leading ``bits`` of the keys."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.blocks = folder, bits, {}

    def __getstate__(self):
        return {"folder": self.folder, "bits": self.bits, "blocks": {}}

    @classmethod
    def write(cls, rows: DataFrame, folder: str, order: int = ORDER) -> RareGrams:
        """Write (lang, gram, p, bow) below ``folder``."""
        bits = max(0, math.ceil(rows.count() / BLOCK_GRAMS) - 1).bit_length()

        def run(batches):
            for batch in batches:
                for k in range(1, order + 1):
                    keys, p, bow = _hashed(batch, k)
                    block = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    columns = [block, np.full(len(keys), k, np.int32), keys.view(np.int64), p, bow]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "size", "key", "p", "bow"])

        keyed = rows.mapInArrow(run, "block bigint, size int, key bigint, p float, bow float")
        unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
        # keys are hashes, so no block is larger than others
        ordered = keyed.repartition("block").sortWithinPartitions("block", "size", unsigned)
        ordered.write.partitionBy("block").parquet(folder)
        return cls(folder, bits)

    def _block(self, number: int) -> dict[int, tuple]:
        if number in self.blocks:
            self.blocks[number] = self.blocks.pop(number)  # the least recently used come first
            return self.blocks[number]
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, base = file_system(self.folder)
        files = system.get_file_info(fs.FileSelector(f"{base}/block={number}", allow_not_found=True))
        out = {}
        for info in files:
            if not info.path.endswith(".parquet"):
                continue
            rows = pq.ParquetFile(system.open_input_file(info.path)).read()
            size, key, p, bow = (rows.column(c).to_numpy() for c in ("size", "key", "p", "bow"))
            for k in np.unique(size).tolist():
                a, b = np.searchsorted(size, [k, k + 1])
                out[k] = (key[a:b].view(np.uint64), p[a:b], bow[a:b])
        while len(self.blocks) >= HELD_BLOCKS:
            del self.blocks[next(iter(self.blocks))]
        self.blocks[number] = out
        return out

    def look(self, k: int, keys: np.ndarray):
        known, p, bow = _find_keys(keys[:0], keys[:0], keys[:0], keys)
        if not len(keys):
            return known, p, bow
        different, back = np.unique(keys, return_inverse=True)
        block = different >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(different), np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            table = self._block(int(block[a])).get(k, (different[:0],) * 3)
            parts.append(_find_keys(*table, different[a:b]))
        known, p, bow = (np.concatenate(x)[back] for x in zip(*parts, strict=True))
        return known, p, bow


class Model:
    """Sorted hash arrays per order: 64-bit keys, log probabilities, log back-off weights."""

    def __init__(self, rows: pa.Table, expected: dict[str, float], rare: RareGrams, order: int = ORDER):
        """``rows``: frequent (lang, gram, p, bow). ``expected``: nats per letter over the corpus, by language."""
        self.order, self.arrays, self.expected, self.rare = order, {}, expected, rare
        self.seeds = {lang: _seed(lang) for lang in rows.column("lang").unique().to_pylist()}
        for k in range(order + 1):
            keys, p, bow = _hashed(rows, k)
            sorted_ = np.argsort(keys)
            self.arrays[k] = (keys[sorted_], p[sorted_], bow[sorted_])

    def _look(self, k, keys):
        known, p, bow = _find_keys(*self.arrays[k], keys)
        rest = np.flatnonzero(~known)
        if k and len(rest):
            known[rest], p[rest], bow[rest] = self.rare.look(k, keys[rest])
        return known, p, bow

    def score(self, lang: str, words: list[str]) -> np.ndarray:
        """Log probability of each word: of all its letters and its end, given its beginning."""
        if lang not in self.seeds or not words:
            return np.zeros(len(words))
        flat, starts = _codes([f"^{w}$" for w in words])
        n = len(flat)
        begin = np.zeros(n, np.int64)
        begin[starts[:-1]] = starts[:-1]
        offset = np.arange(n) - np.maximum.accumulate(begin)
        todo = np.flatnonzero(offset > 0)
        total, weight = np.zeros(n), np.zeros(n)
        seed = self.seeds[lang]
        for k in range(self.order, -1, -1):  # highest order first; what is not found backs off
            fits = todo[offset[todo] >= k - 1] if k > 1 else todo
            keys = np.full(len(fits), seed, np.uint64)
            for j in range(k - 1, 0, -1):
                keys = _push(keys, flat[fits - j])
            if k > 1:
                context = keys
            if k:
                keys = _push(keys, flat[fits])
            known, p, _ = self._look(k, keys)
            if not k:
                known, p = np.ones(len(fits), bool), np.full(len(fits), self.arrays[0][1][np.searchsorted(self.arrays[0][0], seed)])
            total[fits[known]] = p[known] + weight[fits[known]]
            if k > 1:
                had, _, bow = self._look(k - 1, context[~known])
                weight[fits[~known]] += np.where(had, bow, 0.0)
            rest = np.ones(n, bool)
            rest[fits[known]] = False
            todo = todo[rest[todo]]
        return np.add.reduceat(total, starts[:-1])


def train(docs: DataFrame, langs: list[str] | None = None) -> tuple[list[str], Model]:
    langs = languages(docs) if langs is None else langs
    counts = materialize(gram_counts(_inputs(docs, langs)), "grams")
    model = materialize(kneser_ney(counts), "model")
    # every count of the input is one scored letter
    events = counts.join(model.drop("n"), ["lang", "gram"]).groupBy("lang")
    expected = events.agg((F.sum(-F.col("n") * F.log("p")) / F.sum("n")).alias("nats")).collect()  # a row per language
    size = F.length("gram")
    least = model.groupBy("lang", size.alias("size")).agg((F.sum("n") / MAX_GRAMS).alias("least"))  # a row per language and order
    sized = model.withColumn("size", size).join(F.broadcast(least), ["lang", "size"])
    frequent = F.col("n") >= F.col("least")
    rows = sized.where(frequent).select("lang", "gram", "p", "bow").toArrow()  # at most MAX_GRAMS rows per language and order
    rare = materialize(sized.where(~frequent).select("lang", "gram", "p", "bow"), "rare")
    rare = RareGrams.write(rare, scratch_path(docs.sparkSession, "rare-blocks"))
    return langs, Model(rows, {r.lang: r.nats for r in expected}, rare)


# --- scores and verdicts -----------------------------------------------------------------------

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"
SCORED = f"doc_id bigint, lang string, {BASE}, log_ppl double"


class _Scorer:
    """Scores words of one language at a time and remembers them."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, lang: str, words: set[str]) -> None:
        known = self.known.setdefault(lang, {})
        if len(known) > HELD:
            known.clear()
        new = list(words.difference(known))
        known.update(zip(new, self.model.score(lang, new).tolist(), strict=True))

    def log_perplexities(self, langs: list[str], split: list[list[str]]) -> list[float | None]:
        """Mean negative log probability per letter of each text; None where there is nothing to score."""
        for lang in set(langs):
            self.learn(lang, set().union(*(w for w, at in zip(split, langs, strict=True) if at == lang)))
        letters = [sum(map(len, w)) + len(w) for w in split]
        out = [
            -sum(map(self.known[lang].__getitem__, w)) / n if n else None
            for w, lang, n in zip(split, langs, letters, strict=True)
        ]
        odd = [i for i, (x, lang) in enumerate(zip(out, langs, strict=True)) if x is not None and x > self.model.expected.get(lang, math.inf) + MIXED]
        if odd:
            words = set().union(*(split[i] for i in odd))
            every = sorted(self.model.seeds)
            for lang in every:
                self.learn(lang, words)
            best = dict(zip(words, map(max, *([self.known[lang][w] for w in words] for lang in every)) if len(every) > 1 else (self.known[every[0]][w] for w in words), strict=True))
            for i in odd:
                out[i] = -sum(map(best.__getitem__, split[i])) / letters[i]
        return out


def _measure(scorer: _Scorer, langs, texts) -> list[dict]:
    split = [words_of(t) for t in texts]
    scores = scorer.log_perplexities(langs, split)
    return [base_counts(text, words) | {"log_ppl": x} for text, words, x in zip(texts, split, scores, strict=True)]


def measure(docs: DataFrame, langs: list[str], model: Model) -> DataFrame:
    """Base counts and log perplexity of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its frequent n-grams, bounded by MAX_GRAMS
    kinds = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("log_ppl", pa.float64())]

    def make():
        scorer = _Scorer(shared.value)

        def apply(batch):
            rows = _measure(scorer, batch.column("lang").to_pylist(), batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), batch.column("lang")] + [pa.array([r[c] for r in rows], k) for c, k in kinds]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", *(c for c, _ in kinds)])

        return apply

    return by_slice(_inputs(docs, langs), make, SCORED)


def bands(measured: DataFrame) -> DataFrame:
    """(lang, low, high): one row per language with enough documents that pass the base rules."""
    good = measured.where(~F.col("base_failed"))
    middle = good.groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("median"), F.count(F.lit(1)).alias("n"))
    off = good.join(F.broadcast(middle), "lang").groupBy("lang", "median", "n")
    spread = off.agg(F.percentile_approx(F.abs(F.col("log_ppl") - F.col("median")), 0.5, 10_000).alias("mad"))
    below = F.greatest(LOWER_BAND * F.col("mad"), F.lit(LEAST_LOWER))
    above = F.greatest(UPPER_BAND * F.col("mad"), F.lit(LEAST_UPPER))
    return spread.where(F.col("n") >= MIN_DOCS).select("lang", (F.col("median") - below).alias("low"), (F.col("median") + above).alias("high"))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, perplexity, and whether it is kept."""
    langs, model = train(docs)
    measured = materialize(measure(docs, langs, model), "measured")
    limits = bands(measured)  # at most LANGUAGES + 1 rows
    inside = F.col("log_ppl").between(F.col("low"), F.col("high"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    rows = measured.join(F.broadcast(limits), "lang", "left").withColumn("kept", kept)
    return rows.withColumn("perplexity", F.round(F.exp("log_ppl"), 4)).drop("low", "high", "log_ppl", "lang")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; each is measured once, in a pass that copies it."""
    langs, model = train(docs)
    shared, own = docs.sparkSession.sparkContext.broadcast(model), set(langs)  # as in measure
    lang_at, text_at = docs.columns.index("lang"), docs.columns.index("text")
    lang, failed, score, band = (free_name(docs, c) for c in ("model_lang", "base_failed", "log_ppl", "band"))
    added = [StructField(lang, StringType()), StructField(failed, BooleanType()), StructField(score, DoubleType())]
    schema = StructType([*docs.schema.fields, *added])
    names = schema.names

    def run(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(lang_at).cast(pa.string()), batch.column(text_at)], names=["lang", "text"])
            done = 0
            for part in slices_of(pair):
                used = [x if x in own else "" for x in part.column("lang").to_pylist()]
                rows = _measure(scorer, used, [t or "" for t in part.column("text").to_pylist()])
                columns = batch.slice(done, part.num_rows).columns
                columns += [pa.array(used, pa.string())]
                columns += [pa.array([r[c] for r in rows], k) for c, k in (("base_failed", pa.bool_()), ("log_ppl", pa.float64()))]
                done += part.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=names)

    measured = materialize(map_by_place(docs, run, schema), "measured")
    limits = bands(measured.select(F.col(lang).alias("lang"), F.col(failed).alias("base_failed"), F.col(score).alias("log_ppl")))
    limits = limits.select(F.col("lang").alias(lang), F.struct("low", "high").alias(band))  # at most LANGUAGES + 1 rows
    inside = F.col(score).between(F.col(f"{band}.low"), F.col(f"{band}.high"))
    kept = measured.join(F.broadcast(limits), lang, "left").where(~F.col(failed) & F.coalesce(inside, F.lit(True)))
    return kept.select(*[F.col(quoted(c)) for c in docs.columns])
