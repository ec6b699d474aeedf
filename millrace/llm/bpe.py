"""BPE encoding and decoding with a transducer lexicon.

Frequent words of the corpus, counted in Spark, are compiled into a minimal acyclic transducer:
equal suffixes share states, and the outputs on the arcs add up to a word's number, under which
its ids are stored. The arrays form one file that every task maps into memory. Words outside the
lexicon are merged exactly, pair of lowest rank first. The lexicon decides how fast a word is
encoded, never how.

Defined cases. Null text: empty, no tokens. Strings of special tokens in a text become their id, as
the tokenizers library does by default. A word of any length is merged with a heap, so long texts
without blanks take n log n steps. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import unicodedata
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import by_slice, id_and_text, slices_of
from millrace.session import materialize, scratch_path

LEXICON_WORDS = 30_000  # most frequent words compiled; a parameter of speed only
LEXICON_WORD_BYTES = 64  # longer words are left to the merges, which bounds the lexicon at about 10 MB
CACHE = 300_000  # chunks a task remembers; twice as many until it forgets those not used again
COUNTED = 8_000_000  # bytes of text a task counts words in before it hands them on, or one longer text

# what the normaliser takes for white space: Unicode's White_Space, as fixed by the standard
_SPACES = regex.compile("[\t-\r \x85\xa0  -     　]+")
_WIDE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # those of them beyond ASCII
_ODD = regex.compile("[\x1c-\x1f]")  # split() takes these for white space, the normaliser does not
_LATIN = regex.compile("[\x00-ɏ]*")  # here all Unicode versions agree on letters, case and composition
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")  # ASCII, without the apostrophe
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for v in range(256):
        out.append(chr(v) if v in plain else chr(256 + extra))
        extra += v not in plain
    return out


class Tokenizer:
    """Vocabulary, merges and rules of a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab.update(self.special)
        self.tokens = [""] * (max(self.vocab.values()) + 1)
        for token, n in self.vocab.items():
            self.tokens[n] = token
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters = byte_letters()
        self.byte_of = {c: v for v, c in enumerate(letters)}
        self.path, self._library = path, None
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.suffix] for c in letters]
        # the same merges as arrays: sorted pair keys, the rank of each, the id each rank makes
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.ranks.values()], np.int32)[order]
        self.made = np.zeros(len(pairs), np.int32)
        self.made[[r for r, _ in self.ranks.values()]] = [n for _, n in self.ranks.values()]

    @property
    def library(self):
        """The library's tokenizer, loaded for the first text beyond Latin letters."""
        if self._library is None:
            self._library = tokenizers.Tokenizer.from_file(self.path)
        return self._library

    def normalise(self, text: str) -> str:
        """NFC and lower case letter by letter (a final sigma is not special)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str):
        """Pieces between white space; no word crosses white space."""
        return _SPACES.split(text) if _ODD.search(text) else text.split()

    def split(self, texts: pa.Array) -> pa.ListArray:
        """The chunks of many texts at once; empty ones among them have no words."""
        wide = pc.match_substring_regex(texts, _WIDE)
        if wide.true_count:
            pairs = zip(texts.to_pylist(), wide.to_pylist(), strict=True)
            texts = pa.array([_SPACES.sub(" ", t) if w else t for t, w in pairs], texts.type)
        return pc.ascii_split_whitespace(texts)

    def words(self, chunk: str):
        """Byte strings of a chunk's words, and ids of the special tokens in it."""
        for part in self.splitter.split(chunk) if "<|" in chunk else (chunk,):
            if part.isascii() and part.isalpha():  # one word of plain letters
                yield part.lower().encode()
            elif part.isascii() and part[:-1].isalpha() and not part[-1].isalnum():  # with one mark behind it
                yield part[:-1].lower().encode()
                yield part[-1].encode()
            elif part in self.special:
                yield self.special[part]
            elif _LATIN.fullmatch(part):
                for w in self.pattern.findall(self.normalise(part)):
                    yield w.encode()
            else:  # the library's own Unicode tables for other scripts
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    yield bytes(map(self.byte_of.__getitem__, w))

    def words_of(self, chunks) -> dict[str, tuple]:
        """The words of many chunks; most are letters, or letters and one mark, and need no pattern."""
        out, latin = {}, _LATIN.fullmatch
        for chunk in chunks:
            low = chunk.lower()
            if low.isalpha() and (low.isascii() or latin(chunk)):
                out[chunk] = (low.encode(),)
            elif (stem := low[:-1]).isalpha() and low[-1] in _MARKS and (stem.isascii() or latin(chunk)):
                out[chunk] = (stem.encode(), low[-1].encode())
            else:
                out[chunk] = tuple(self.words(chunk))
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merges: the pair of lowest rank first, the leftmost of equal ones."""
        ids = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := ranks.get((ids[i], ids[i + 1]))) is not None:
                heap.append((r[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = ranks[(a, b)][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], _NONE)

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """``merge`` of many words at once."""
        return [np.frombuffer(ids, "<u4") for ids in self.merge_packed(words)]

    def merge_packed(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many words: one merge of every word per step, words of like length together."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 6), (7, 10), (11, 16), (17, LEXICON_WORD_BYTES)):
            chosen = np.flatnonzero((lengths >= low) & (lengths <= high))
            for at in range(0, len(chosen), 20_000):
                group = chosen[at : at + 20_000]
                for w, ids in zip(group, self._merge_group([words[w] for w in group], high), strict=True):
                    out[w] = ids
        for w in np.flatnonzero(lengths > LEXICON_WORD_BYTES):
            out[w] = np.array(self.merge(words[w]), "<u4").tobytes()
        return out

    def _merge_group(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = np.array(self.inner, np.int32)[letters]
        row = np.arange(n)
        ids[row, lengths - 1] = np.array(self.final, np.int32)[letters[row, lengths - 1]]
        ids[np.arange(width) >= lengths[:, None]] = -1
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], axis=1)
        ranks = np.concatenate([self._rank(ids[:, :-1], ids[:, 1:]), np.full((n, 1), _NONE, np.int32)], axis=1)
        done: list = [None] * n
        column = np.arange(width + 1)
        while len(row):
            at = ranks.argmin(axis=1)
            here = np.arange(len(row))
            best = ranks[here, at]
            over = best == _NONE
            if over.any():
                ended = ids[over]  # ids stand on the left of a row
                content, step = ended.astype("<u4").tobytes(), 4 * (width + 1)
                places = zip(row[over].tolist(), (4 * (ended >= 0).sum(axis=1)).tolist(), strict=True)
                for i, (at_word, size) in enumerate(places):
                    done[at_word] = content[i * step : i * step + size]
                live = ~over
                row, ids, ranks, at, best = row[live], ids[live], ranks[live], at[live], best[live]
                here = np.arange(len(row))
                if not len(row):
                    break
            ids[here, at] = self.made[best]
            left = np.minimum(column + (column > at[:, None]), width)  # drop the merged pair's second id
            ids = np.take_along_axis(ids, left, axis=1)
            ids[:, -1] = -1
            ranks = np.take_along_axis(ranks, left, axis=1)
            ranks[:, -1] = _NONE
            ranks[here, at] = self._rank(ids[here, at], ids[here, np.minimum(at + 1, width)])
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1] = self._rank(ids[back, at[back] - 1], ids[back, at[back]])
        return done

    def decode(self, ids) -> str:
        """Without a decoder in the file the library joins the tokens with blanks."""
        return " ".join(map(self.tokens.__getitem__, ids))


# --- the lexicon ---------------------------------------------------------------------------


def compile_lexicon(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of the words, as arrays.

    Words are added in order; a state is frozen once no later word can reach it, and a frozen
    state with the same arcs replaces it. ``below`` counts the words a state leads to, so the
    outputs of the arcs (words that sort before) add up to the word's number.
    """
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # per frozen state: ((byte, target), ...)
    final: list[bool] = []
    below: list[int] = []
    path: list[tuple[list, bool]] = [([], False)]  # unfrozen states along the last word
    last = b""

    def freeze(edges, accepts) -> int:
        key = (tuple(edges), accepts)
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[0])
            final.append(accepts)
            below.append(accepts + sum(below[t] for _, t in edges))
        return register[key]

    def close(depth):
        while len(path) > depth + 1:
            edges, accepts = path.pop()
            path[-1][0].append((last[len(path) - 1], freeze(edges, accepts)))

    words = sorted(entries)
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        path.extend(([], False) for _ in word[common:])
        path[-1] = (path[-1][0], True)
        last = word
    close(0)
    root = freeze(*path[0])
    keys, targets, outputs = [], [], []
    for state, edges in enumerate(arcs):
        passed = int(final[state])
        for byte, target in edges:
            keys.append(state << 8 | byte)
            targets.append(target)
            outputs.append(passed)
            passed += below[target]
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable") if keys else np.zeros(0, np.int64)
    ids = [entries[w] for w in words]
    starts = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=starts[1:])
    return {
        "keys": np.array(keys, np.int64)[order],
        "targets": np.array(targets, np.int32)[order],
        "outputs": np.array(outputs, np.int32)[order],
        "final": np.array(final, np.bool_),
        "starts": starts,
        "ids": np.array([x for w in ids for x in w], np.uint32),
        "root": np.array([root], np.int64),
    }


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a JSON line with kinds and places, then the arrays, aligned for mapping."""
    at, places, body = 0, {}, io.BytesIO()
    for name, a in arrays.items():
        pad = -at % 64
        body.write(b"\0" * pad + a.tobytes())
        places[name] = [str(a.dtype), at + pad, len(a)]
        at += pad + a.nbytes
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 9) % 64)
    return f"{len(head):08d}".encode() + b"\n" + head + body.getvalue()


class Lexicon:
    """A compiled lexicon mapped into memory; looks up many words at a time."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        size = int(bytes(raw[:8]))
        places = json.loads(bytes(raw[9 : 9 + size]))
        for name, (kind, at, n) in places.items():
            start = 9 + size + at
            setattr(self, name, raw[start : start + n * np.dtype(kind).itemsize].view(kind))

    def find(self, words: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each word, None for words outside; all words step through the arcs together."""
        out: list[np.ndarray | None] = [None] * len(words)
        if not words or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.root[0], np.int64)
        number = np.zeros(len(words), np.int64)
        live = np.flatnonzero(lengths <= LEXICON_WORD_BYTES)
        depth = 0
        while len(live):
            ended = lengths[live] == depth
            for w in live[ended & self.final[state[live]]]:
                n = number[w]
                out[w] = self.ids[self.starts[n] : self.starts[n + 1]]
            live = live[~ended]
            if not len(live):
                break
            key = state[live] << 8 | flat[starts[live] + depth]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            good = self.keys[arc] == key
            live, arc = live[good], arc[good]
            number[live] += self.outputs[arc]
            state[live] = self.targets[arc]
            depth += 1
        return out


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def count_words(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(word, n): words of all texts as the tokenizer splits them, counted per task first.

    A task hands its counts on after every ``COUNTED`` bytes of text, so its memory is bounded.
    """

    def run(batches):
        tokenizer = Tokenizer(tokenizer_path)
        held: list[pa.Array] = []

        def flush():
            counts = pa.chunked_array(held).value_counts()
            held.clear()
            chunks = _strings(counts.field("values"))
            times = dict(zip(chunks, counts.field("counts").to_numpy().tolist(), strict=True))
            words: Counter = Counter()
            for chunk, found in tokenizer.words_of(chunks).items():
                n = times[chunk]
                for w in found:
                    if isinstance(w, bytes) and len(w) <= LEXICON_WORD_BYTES:
                        words[w] += n
            return pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.binary()), "n": pa.array(words.values(), pa.int64())})

        size = 0
        for batch in batches:
            for part in slices_of(batch):
                more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and size + more > COUNTED:
                    yield flush()
                    size = 0
                held.append(tokenizer.split(part.column("text")).flatten())
                size += more
        if held:
            yield flush()

    counted = id_and_text(docs).select("text").mapInArrow(run, "word binary, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def write_lexicon(docs: DataFrame, tokenizer_path: str, size: int = LEXICON_WORDS) -> str:
    """Compile the corpus's most frequent words, ``size`` at most, and write the file to the shared folder."""
    spark = docs.sparkSession
    counted = materialize(count_words(docs, tokenizer_path), "word-counts")
    # counts in steps of an eighth of a power of two: at most 512 rows tell from which step on to compile
    step = F.floor(F.log2("n") * 8).cast("int")
    room, least = size, None
    for row in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row.step
    top = [] if least is None else counted.where(step >= least).select("word").collect()  # ``size`` short words at most
    tokenizer = Tokenizer(tokenizer_path)
    content = pack_arrays(compile_lexicon({bytes(r.word): tokenizer.merge(bytes(r.word)) for r in top if r.word}))
    path = scratch_path(spark, "lexicon")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(content))
    stream.close()
    return path


ENCODED = "doc_id bigint, ids binary, n_tokens bigint"


def _encoder(tokenizer_path: str, lexicon_file: str):
    """A function from texts to their ids (little-endian unsigned 32 bit), with caches of its own."""
    from pyspark import SparkFiles

    tokenizer = Tokenizer(tokenizer_path)
    lexicon = Lexicon(SparkFiles.get(lexicon_file))
    cache: dict[str, bytes] = {}
    older: dict[str, bytes] = {}
    specials = {n: n.to_bytes(4, "little") for n in tokenizer.special.values()}
    known: dict = dict(specials)

    def learn(chunks) -> None:
        """Ids of all new words of a slice at once: from the lexicon, or else merged."""
        parts = tokenizer.words_of(chunks)
        words = list(set().union(*parts.values()).difference(known))
        unseen = []
        for w, ids in zip(words, lexicon.find(words), strict=True):
            if ids is None:
                unseen.append(w)
            else:
                known[w] = ids.tobytes()
        for w, ids in zip(unseen, tokenizer.merge_packed(unseen), strict=True):
            known[w] = ids
        get = known.__getitem__
        for c, p in parts.items():
            cache[c] = get(p[0]) if len(p) == 1 else b"".join(map(get, p))

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each text begin, with the end of the last."""
        split = tokenizer.split(texts)
        coded = split.flatten().dictionary_encode()
        chunks = _strings(coded.dictionary)
        nonlocal cache, older, known
        if len(cache) > CACHE:
            cache, older = {}, cache
        if len(known) > CACHE:
            known = dict(specials)
        new = set(chunks).difference(cache)
        cache.update((c, older[c]) for c in new if c in older)
        new.difference_update(older)
        if new:
            learn(new)
        ids = pa.array(list(map(cache.__getitem__, chunks)), pa.large_binary()).take(coded.indices)
        flat, ends = _in_a_row(ids)
        return np.frombuffer(flat, "<u4"), ends[split.offsets.to_numpy()] // 4

    return tokenizer, encode


def _in_a_row(values: pa.LargeBinaryArray) -> tuple[memoryview, np.ndarray]:
    """The bytes of all values one behind the other, and where each value begins, with the end of the last."""
    if not len(values):
        return memoryview(b""), np.zeros(1, np.int64)
    _, places, content = values.buffers()
    ends = np.frombuffer(places, np.int64, len(values) + 1)
    return memoryview(content or b"")[: ends[-1]], ends


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens) of every whole text; ids packed as little-endian unsigned 32 bit."""
    name = _ship(docs.sparkSession, lexicon or write_lexicon(docs, tokenizer_path))

    def make():
        _, enc = _encoder(tokenizer_path, name)

        def apply(batch):
            ids, at = enc(batch.column("text"))
            packed = pa.array([ids[a:b].tobytes() for a, b in pairwise(at)], pa.binary())
            sizes = pa.array(np.diff(at), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), packed, sizes], names=["doc_id", "ids", "n_tokens"])

        return apply

    return by_slice(id_and_text(docs), make, ENCODED)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches):
        tokenizer = Tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [tokenizer.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, tokenizer_path: str, lexicon: str | None = None) -> DataFrame:
    """Encode and decode every text in one pass; digests of both, so neither leaves the task."""
    name = _ship(docs.sparkSession, lexicon or write_lexicon(docs, tokenizer_path))

    def make():
        tokenizer, enc = _encoder(tokenizer_path, name)
        blanked = pa.array([t.encode() + b" " for t in tokenizer.tokens], pa.large_binary())

        def digests(content, places) -> pa.Array:
            return pa.array([hashlib.sha256(content[a:b]).hexdigest() for a, b in places], pa.string())

        def apply(batch):
            ids, at = enc(batch.column("text"))
            # tokens are joined with blanks: each is written with one behind it, a text goes without its last
            decoded, ends = _in_a_row(blanked.take(pa.array(ids)))
            begins = ends[at]
            texts = zip(begins[:-1].tolist(), np.maximum(begins[1:] - 1, begins[:-1]).tolist(), strict=True)
            columns = [batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), digests(ids, pairwise(at.tolist())), digests(decoded, texts)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return apply

    return by_slice(id_and_text(docs), make, DIGESTS)


def _ship(spark: SparkSession, path: str) -> str:
    """Let every executor, also a later one, fetch the lexicon file from the shared folder."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]
