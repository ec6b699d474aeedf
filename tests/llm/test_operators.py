"""Each operator against a brute-force version, and on rows that are null, empty, repeated or very long."""

import collections
import hashlib
import re
import unicodedata

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, chat, decontaminate, licences, lines, pii, quality, queries, simhash, similar, suffixes, warc
from tests.harness import compare, duck
from tests.llm.conftest import HARD, SMALL

QUICK = settings(max_examples=150, deadline=None)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", ["op1_pii", "op2_simhash", "op4_lines", "op5_bpe", "op6_licences", "op7_suffixes", "op8_quality"])
def test_hard_rows_and_empty_tables(spark, hard, empty, tmp_path, name):
    for df, n in ((hard, len(HARD)), (empty, 0)):
        folder = str(tmp_path / f"{name}{n}")
        df.write.parquet(f"{folder}/documents.parquet")
        got = queries.QUERIES[name](spark, folder).collect()
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _, _ in HARD[:n])
        same = [r for r in got if r.doc_id == 4]
        assert len(set(map(str, same))) <= (2 if name in ("op4_lines",) else 1)


def test_stages_keep_the_columns(spark, hard, empty):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "no id here " * 5)], "item_id bigint, text string")
    for df in (hard, empty):
        assert quality.keep_good(df).schema.simpleString() == df.schema.simpleString()
        for out in (quality.keep_good(df), simhash.keep_one(df), decontaminate.keep_clean(df, benchmark), pii.sanitise(df)):
            assert out.columns == df.columns
            out.collect()
    assert sorted(r.doc_id for r in simhash.keep_one(hard).collect() if r.doc_id in (4, 5)) == [4]
    assert None not in [r.doc_id for r in decontaminate.keep_clean(hard, benchmark).collect()]
    assert [r.text for r in pii.sanitise(hard).collect() if r.doc_id == 7] == ["mail [EMAIL] now"]


# --- 1

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 12 <= len(d := re.sub(r"\D", "", s)) <= 19 and luhn(d),
        "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15,
    }
    return sorted((m.start(), list(PLAIN).index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good[k](m.group()))


@QUICK
@given(st.text(alphabet="a1.@+- ()450é%", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data_digests(spark, docs, texts):
    for i, r in by_id(pii.personal_data(docs)).items():
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(texts[i]))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_a_term_that_stands_only_beside_a_value_is_masked(spark):
    rows = [(i, f"some words number{chr(97 + i)} here zorblax writes to joe@site.org about thing{chr(97 + i)}") for i in range(6)]
    rows += [(100 + i, f"some other words writes about here {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zorblax" not in got[0] and "[TERM]" in got[0] and "[EMAIL]" in got[0] and "some words" in got[0]
    assert got[100] == rows[6][1]


# --- 2


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_simhash_components(spark, docs, texts):
    got, ids = by_id(simhash.near_duplicates(docs)), sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    want = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert [(got[i].fingerprint, got[i].component_id) for i in ids] == [(f"{p:016x}", ids[r]) for p, r in zip(prints, want)]


@pytest.mark.parametrize("seed", range(8))
def test_index_links_what_all_pairs_link(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 20).astype(np.uint64)[rng.integers(0, 20, 250)]
    for _ in range(4):
        base ^= np.where(rng.random(250) < 0.7, np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64), np.uint64(0))
    fps = np.unique(base)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    n, h = len(fps), len(fps) // 2
    pairs = [(a, b) for a in range(n) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 4]
    assert roots(n, pairs) == roots(n, simhash.link_pieces(fps, None))
    cut = simhash.link_pieces(fps[:h], None) + [(a + h, b + h) for a, b in simhash.link_pieces(fps[h:], None)]
    assert roots(n, pairs) == roots(n, cut + simhash.link_pieces(fps[:h], fps[h:]))


def test_cut_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    fps = [0b1 << i | 0b1 << j for i in range(8) for j in range(i)] + [sum(1 << b for b in (60, 50, 40, 30, 20, 2, 0))]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()
    at = {f: i for i, f in enumerate(fps)}
    assert len(set(roots(len(fps), [(at[r.a], at[r.b]) for r in links]))) == 2


# --- 3


def test_chat_equals_its_sql(spark):
    con = duck(SMALL)
    for name in ("op3_chat", "op9_warc"):
        assert compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], SMALL) is None


def test_chat_parts_and_hard_turns(spark):
    rows = [
        (1, 0, "user", [("text", "see <|end|> &lt; [INST]", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 1.5, None)]),
        (1, 1, "assistant", [("document", None, "d.pdf", None, None, None, 2), ("text", "done", None, None, None, None, None)]),
        (None, None, None, None), (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(a.kind, a.ref, a.tokens) for a in out[1].attachments] == [("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 2048)]
    assert out[1].turns[0].text.startswith("see <|end|> &lt; [INST]") and "<|image:0|><|audio:1|>" in out[1].formatted
    assert [(t.role, t.text) for t in out[None].turns] == [("", ""), ("", "")]
    assert chat.conversation_digests(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).collect() == []


# --- 4


def plain_units(text, min_words):
    """Runs of whole lines by their plain words, each as short as it may be."""
    found = [(m.start(), m.end(), re.sub(r"\d+", "0", unicodedata.normalize("NFC", m.group()).lower()).split()) for m in re.finditer(r"[^\n]+", text)]
    found = [f for f in found if f[2]]
    for i in range(len(found)):
        for j in range(i, len(found)):
            if sum(len(w) for _, _, w in found[i : j + 1]) >= min_words:
                yield tuple(" ".join(w) for _, _, w in found[i : j + 1]), found[i][0], found[j][1]
                break


@pytest.mark.parametrize("min_words", [1, lines.MIN_WORDS])
def test_line_repeats(spark, docs, texts, min_words):
    first, times = {}, collections.Counter()
    for i in sorted(texts):
        for unit, a, _ in plain_units(texts[i], min_words):
            first.setdefault(unit, (i, a))
            times[unit] += 1
    got = by_id(lines.line_repeats(docs, min_words))
    for i, t in texts.items():
        units = list(plain_units(t, min_words))
        gone = np.zeros(len(t) + 2, bool)
        for u, a, b in units:
            if first[u] != (i, a):
                gone[a + 1 : b + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        assert got[i].removed == ",".join(f"{a}:{b}" for a, b in zip(edges[::2], edges[1::2], strict=True))
        assert (got[i].n_units, got[i].n_repeated, got[i].n_removed) == (len(units), sum(times[u] > 1 for u, _, _ in units), len(edges) // 2)
    cut = {r.doc_id: r for r in lines.remove_repeats(docs, min_words=min_words).collect()}
    kept_lines = collections.Counter()
    for i, t in texts.items():
        spans = [(s.start, s.end) for s in cut[i].removed_spans]
        kept = "".join(c for at, c in enumerate(t) if not any(a <= at < b for a, b in spans))
        assert cut[i].text == kept
        kept_lines.update(u for (u,), _, _ in plain_units(kept, 1))
    # every line is still somewhere
    assert set(kept_lines) == {u for t in texts.values() for (u,), _, _ in plain_units(t, 1)}


def test_repeats_of_short_lines_go(spark):
    df = spark.createDataFrame([(1, "Les.\n\nAnd ornd."), (2, "les.\n \nnew\nLes.")], "doc_id bigint, text string")
    got = by_id(lines.line_repeats(df, min_words=1))
    assert [(got[i].n_units, got[i].removed) for i in (1, 2)] == [(2, ""), (3, "0:4,11:15")]
    assert by_id(lines.remove_repeats(df, min_words=1))[2].text == "\n \nnew\n"
    assert all(r.removed == "" for r in lines.line_repeats(df).collect())


def test_short_lines_of_a_repeated_run_go(spark):
    run = "\n".join(f"a few words {w}" for w in ("one", "two", "three", "four", "five"))
    df = spark.createDataFrame([(1, f"Les.\n{run}\nend"), (2, f"begin\n{run}\nLes.")], "doc_id bigint, text string")
    got = by_id(lines.remove_repeats(df))
    assert got[1].text == f"Les.\n{run}\nend" and got[2].text == "begin\n\nLes."


# --- 5


@pytest.fixture(scope="module")
def tokenizers_():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    return Tokenizer.from_file(path), bpe.Tokenizer(path)


def own_ids(own, text):
    words = [w for c in own.chunks(text) for w in own.words(c)]
    return [x for w in words for x in (own.merge(w) if isinstance(w, bytes) else [w])], words


@QUICK
@given(st.text(max_size=30) | st.text(alphabet="aAbetsS' .,!é1\x1c <|endoftx>", max_size=30))
def test_bpe_equals_the_library(tokenizers_, text):
    library, own = tokenizers_
    ids, words = own_ids(own, text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    words = [w for w in words if isinstance(w, bytes)]
    assert [x.tolist() for x in own.merge_many(words)] == [own.merge(w) for w in words]


def test_lexicon_finds_its_words_only(tmp_path, tokenizers_, texts):
    own = tokenizers_[1]
    words = sorted({w for t in texts.values() for w in own_ids(own, t)[1] if isinstance(w, bytes) and len(w) <= 64})
    arrays = bpe.compile_lexicon({w: own.merge(w) for w in words[::2]})
    (tmp_path / "lexicon").write_bytes(bpe.pack_arrays(arrays))
    found = bpe.Lexicon(str(tmp_path / "lexicon")).find(words + [b""])
    assert [None if f is None else f.tolist() for f in found] == [own.merge(w) if i % 2 == 0 else None for i, w in enumerate(words)] + [None]
    assert len(arrays["final"]) < sum(map(len, words[::2])) / 2  # suffixes are shared


def test_round_trip_digests(spark, docs, texts, tokenizers_):
    library = tokenizers_[0]
    for i, r in by_id(bpe.round_trip_digests(docs, queries.tokenizer_path())).items():
        ids = library.encode(texts[i], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- 6


def test_licences(spark, docs, texts):
    got = by_id(licences.licence_labels(docs))
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        at = [(k, label) for p, label in licences.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want = (len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert {x for _, x in at} <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1


@QUICK
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=20))
def test_matching_statistics(templates, text):
    automaton = licences.SuffixAutomaton()
    for n, t in enumerate(templates):
        automaton.add(t, n)
    known = {tuple(t[a:b]): {n for n, u in enumerate(templates) if any(u[i : i + b - a] == t[a:b] for i in range(len(u)))} for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    for at, (length, state) in enumerate(automaton.statistics(text)):
        best = max((k for k in range(at + 2) if k == 0 or tuple(text[at + 1 - k : at + 1]) in known), default=0)
        assert length == best
        if length:
            assert set(automaton.ends[state]) == known[tuple(text[at + 1 - length : at + 1])]


def test_a_notice_in_a_long_text_is_found():
    notice = licences.TEMPLATES["mit"][0]
    found = licences.Scanner().scan("word " * 5000 + notice.replace("merge,", "fuse,") + " tail" * 50)
    assert found["labels"] == "mit" and found["score"] > 0.9 and found["template_spans"][0]["first_word"] == 5000


# --- 7


@pytest.mark.parametrize("crowd", [0, 4096])
def test_suffixes_equal_brute_force(spark, docs, texts, crowd):
    long_run = "ab" * 300
    extra = spark.createDataFrame([(10_000, long_run), (10_001, "é" * 150), (10_002, "z" + "é" * 150), (10_003, "x" * 199), (10_004, "x" * 199)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").limit(80).unionByName(extra)
    data = {r.doc_id: r.text.encode() for r in both.collect()}
    seen = collections.Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    got = by_id(suffixes.cut_documents(both, crowd=crowd))
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        assert bytes(np.frombuffer(b, np.uint8)[~gone]) == bytes(got[i].kept)
        assert len(got[i].removed) == int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())


def test_suffix_sort():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    s, places = suffixes.Suffixes(data, 12), np.arange(2900)
    order = s.sort(places, np.repeat([0, 1], 1450))
    for half in (order[:1450], order[1450:]):
        strings = [data[p : p + 12].tobytes() for p in places[half]]
        assert strings == sorted(strings)


# --- 8


def test_base_rules(spark, docs, texts):
    for i, r in by_id(quality.verdicts(docs)).items():
        t = texts[i]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeats = len({k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)})
        rows = t.split("\n")
        again = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in rows[:k] for k, x in enumerate(rows))
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), again, repeats, len(words) < 50 or 100 * repeats > 50 * len(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)


def test_model_sums_to_one_and_the_bands_reject_noise(spark):
    plain = [(i, " ".join(f"{'ab' if (i + j) % 3 else 'bac'}" for j in range(60)), "en") for i in range(60)]
    rng = np.random.default_rng(1)
    noise = [(100, " ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(80)), "en")]
    df = spark.createDataFrame(plain + noise, "doc_id bigint, text string, lang string")
    _, model = quality.train(df)
    words = ["".join(w) for w in ("a", "b", "c", "ab", "bac")]
    assert (model.score("en", words) < 0).all() and model.score("en", ["ab"])[0] > model.score("en", ["qx"])[0]
    rows = quality.kneser_ney(quality.gram_counts(quality._inputs(df, ["en"]))).toPandas()
    for context in ("", "^", "a", "ba"):
        total = rows[(rows.gram.str.len() == len(context) + 1) & rows.gram.str.startswith(context)].p.sum()
        assert total <= 1.001
    base_passes = df.where("doc_id = 100")
    assert base_passes.count() == 1
    measured = quality.measure(df, ["en"], model).collect()
    scores = {r.doc_id: r.log_ppl for r in measured}
    assert scores[100] > max(v for k, v in scores.items() if k != 100) + 0.5


def test_rare_grams_in_the_shared_folder_give_the_same_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "MAX_GRAMS", 1 << 40)  # everything is broadcast
    langs, whole = quality.train(docs)
    want = by_id(quality.measure(docs, langs, whole))
    monkeypatch.setattr(quality, "MAX_GRAMS", 50)
    monkeypatch.setattr(quality, "BLOCK_GRAMS", 500)
    monkeypatch.setattr(quality, "HELD_BLOCKS", 2)
    _, split = quality.train(docs, langs)
    assert split.rare.bits >= 2 and all(len(split.arrays[k][0]) <= 50 * (len(langs) + 1) < len(whole.arrays[k][0]) for k in (3, 4))
    words = sorted({w for t in docs.limit(40).toPandas().text.fillna("") for w in quality.words_of(t)}) + ["qqxz", "日本"]
    for lang in langs:
        assert split.score(lang, words).tolist() == whole.score(lang, words).tolist()
    assert len(split.rare.blocks) <= 2
    got = by_id(quality.measure(docs, langs, split))
    assert {i: r.lang for i, r in got.items()} == {i: r.lang for i, r in want.items()}
    assert all(r.log_ppl == want[i].log_ppl or abs(r.log_ppl - want[i].log_ppl) < 1e-9 for i, r in got.items())


# --- 9


def test_archives_hold_the_pages(spark, tmp_path):
    big, rows = "<p>" + "text " * 400, []
    rows = [(1, "u\r\nx", big), (2, None, big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (None, "u", None), (5, "u", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = str(tmp_path / "a")
    warc.write_archives(pages, folder)
    got = warc.read_archives(spark, folder).collect()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == {(1, "revisit", 2): 1, (2, "response", None): 2, (3, "response", None): 1, (4, "response", None): 1, (None, "response", None): 1, (5, "response", None): 1}
    texts = {i: (h or "") for i, _, h in rows}
    assert all(bytes(r.payload).decode() == texts[r.page_id] for r in got if r.record_type == "response")
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def test_archive_has_a_dictionary_in_front():
    import zstandard

    records = [warc.record(i, "u", f"<html><p>page {i} of the site</p>".encode() * 20, "0", None) for i in range(2000)]
    packed = warc.pack(records)
    assert packed[:4] == warc.DICT_MAGIC and len(list(warc.unpack(packed))) == 2000
    with pytest.raises(Exception):  # records need the dictionary
        size = int.from_bytes(packed[4:8], "little")
        zstandard.ZstdDecompressor().decompressobj().decompress(packed[8 + size :])


# --- 10


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_decontamination_finds_what_the_budget_allows(data):
    word = st.sampled_from("the of an tion er on ing es re at en".split())
    text = st.lists(st.lists(word, min_size=1, max_size=3).map("".join), min_size=1, max_size=25).map(" ".join)
    items = [(i, t) for i, t in enumerate(data.draw(st.lists(text, min_size=1, max_size=5)))]
    chosen = list(data.draw(st.sampled_from(items))[1])
    for _ in range(data.draw(st.integers(0, 4))):
        at = data.draw(st.integers(0, len(chosen)))
        chosen[at : at + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from(["", "q"]))
    doc = data.draw(text) + " " + "".join(chosen) + " " + data.draw(text)
    index = decontaminate.Index(items)
    folded = decontaminate.fold(doc)
    want = {}
    for n, (i, t) in enumerate(items):
        best = edits(t, folded) if len(t) >= decontaminate.Q else (0 if t in folded else 99)
        if best <= index.k[n]:
            want[i] = best
    assert {i: e for i, _, _, e in index.find(doc)} == want


def test_blocks_of_the_benchmark_give_the_same(spark, docs):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = decontaminate.find_benchmark(docs, benchmark).collect()
    assert sorted(whole) == sorted(decontaminate.find_benchmark(docs, benchmark, block_chars=3000).collect()) and whole


# --- pipeline


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted_copies(originals=30, copies=4):
    """Texts of 120 words, each with copies of similarity 0.8 to 0.97 to it (exact, by ``plain_set``)."""
    random = np.random.RandomState(7)
    out = []
    for g in range(originals):
        base = [f"w{random.randint(5000)}" for _ in range(120)]
        out.append((g, " ".join(base)))
        made = 0
        while made < copies:
            other = list(base)
            for at in random.choice(120, random.randint(1, 4), replace=False):
                other[at] = f"x{random.randint(10**6)}"
            if plain_similarity(plain_set(" ".join(base)), plain_set(" ".join(other))) >= 0.8:
                out.append((g, " ".join(other)))
                made += 1
    return out


def test_near_copies_of_the_contract_similarity_go(spark):
    rows = planted_copies()
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, df, SMALL).collect())
    assert kept == [i for i in range(len(rows)) if i % 5 == 0]


@pytest.mark.parametrize("crowd", [2, 64])
def test_similar_sets_against_all_pairs(spark, docs, monkeypatch, crowd):
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "PIECE", 700)
    monkeypatch.setattr(similar, "COUNTED", 2)
    texts = [t for _, t in planted_copies(12, 6)] + [r.text for r in docs.limit(120).collect()] + [None, "", "a b", "A  b", "a b c"]
    # a chain in one hot bucket: neighbours are similar, ends are not; and texts that only share a passage
    words = [f"c{i}" for i in range(60)]
    for i in range(12):
        texts.append(" ".join([*[f"n{j}" for j in range(i)], *words[i:]]))
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"{passage} " + " ".join(f"u{k}x{j}" for j in range(4 + k % 5)) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [plain_set(t) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if plain_similarity(sets[a], sets[b]) >= 0.8]
    heads = sorted(set(roots(len(sets), pairs)))
    assert sorted(r.doc_id for r in simhash.keep_one_similar(df).collect()) == heads


def test_pipeline_stages(spark, docs):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    one = corpus_pipeline.STAGES[0][1](spark, docs, SMALL).cache()
    assert {r.doc_id for r in one.collect()} == kept
    left = sorted((r.doc_id, r.text) for r in one.collect())
    sets = [plain_set(t) for _, t in left]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if plain_similarity(sets[a], sets[b]) >= 0.8]
    heads = {left[i][0] for i in roots(len(sets), pairs)}
    two = corpus_pipeline.STAGES[1][1](spark, one, SMALL).cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted(heads)
    dirty = {r.doc_id for r in decontaminate.find_benchmark(two, benchmark).collect()}
    three = corpus_pipeline.STAGES[2][1](spark, two, SMALL).cache()
    assert {r.doc_id for r in three.collect()} == heads - dirty
    four = {r.doc_id: r.text for r in corpus_pipeline.STAGES[3][1](spark, three, SMALL).collect()}
    assert not any(plain_spans(t) for t in four.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()} == set(four)


def test_quality_stage_keeps_columns_that_share_its_names(spark, docs):
    own = docs.limit(60).withColumns({c: F.col("doc_id").cast("string") for c in ("model_lang", "base_failed", "log_ppl", "Band")})
    kept = quality.keep_good(own)
    assert kept.schema.names == own.schema.names
    got = kept.collect()
    assert got and all({r.model_lang, r.base_failed, r.log_ppl, r.Band} == {str(r.doc_id)} for r in got)
    good = {r.doc_id for r in quality.verdicts(own).where("kept").collect()}
    assert {r.doc_id for r in got} == good


def test_the_stage_takes_the_links_of_the_index(spark):
    """Texts whose fingerprints are near, but whose 5-word sets are not similar, are one group in the pipeline."""
    texts = ["a b c d e f g " * 100 + f"u{i} v{i} w{i}" for i in range(2)] + ["something else that stands alone here"]
    prints = [simhash.fingerprint(t) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_similar(df).collect()) == [0, 1, 2]
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, df, SMALL).collect()) == [0, 2]
