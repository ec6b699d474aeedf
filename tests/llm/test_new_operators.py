"""Spelling variants, whitening and the secret ledger against brute-force versions and hard rows."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from millrace.llm import lines, queries, secret_scan, simhash, spelling, whitening
from millrace.session import scratch_path
from tests.llm.conftest import HARD

QUICK = settings(max_examples=100, deadline=None)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- 11


def plain_words(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(words):
    """Pairs that share a word with one code point left out, or are such a word, checked one by one."""
    holes = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    near = collections.defaultdict(set)
    for group in holes.values():
        for a, b in itertools.permutations(group, 2):
            if within_one(a, b):
                near[a].add(b)
    return near


def plain_variants(counts):
    near = plain_near(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


@QUICK
@given(st.sets(st.text(alphabet="abé", min_size=1, max_size=6), min_size=1, max_size=40))
def test_both_searches_find_all_near_words(words):
    words = sorted(words)
    found = set()
    for half in (spelling.FIRST, spelling.SECOND):
        for q, k in spelling.near_words(words, words, half):
            found |= set(zip(q.tolist(), k.tolist(), strict=True))
    assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if within_one(a, b)}


def test_search_of_words_with_symbols_the_index_lacks():
    found = [(q.tolist(), k.tolist()) for h in (0, 1) for q, k in spelling.near_words(["abcdefg"], ["abcdefz", "xbcdefg", "zzz"], h)]
    assert sorted(itertools.chain(*[q for q, _ in found])) == [0, 1]


def test_suffix_order_is_that_of_sorted_suffixes():
    words = sorted(["banana", "band", "ban", "nab", "ana"])
    symbols, _, lengths = spelling._flat(words, np.unique([ord(c) for c in "".join(words)]).astype(np.uint32), False)
    text = "#" + "#".join(words) + "#"
    coded = np.zeros(len(text), np.int32)
    coded[[i for i, c in enumerate(text) if c != "#"]] = symbols
    order = spelling.suffix_order(coded, 7)
    assert [text[p:].split("#")[0] for p in order if text[p] != "#"] == sorted(text[p:].split("#")[0] for p in order if text[p] != "#")


@pytest.mark.parametrize("piece", [spelling.PIECE, 3000, 200])
def test_spelling_variants(spark, docs, texts, monkeypatch, piece):
    monkeypatch.setattr(spelling, "PIECE", piece)
    rows = list(texts.items())
    if piece == 200:  # shards of several pieces: brute force is the small table of the hot words only
        rows = rows[:20]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in spelling.spelling_variants(docs).collect()}
    assert got == plain_variants(plain_words(rows))


def test_a_chain_of_forms_ends_in_one_root(spark):
    words = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "bbbbbbb": 3, "caaaaab": 100}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {tuple(r) for r in spelling.variants(df).collect()}
    assert got == plain_variants(words)
    assert {r[0]: r[2] for r in got}["aaaaaaa"] in ("aaaabbb", "caaaaab")


# --- 12


def plain_whitening(rows, wanted=32):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept], object)
    n, sums = len(x), x.sum(axis=0)
    whole = x * n - sums
    centred = whole.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:wanted], axes[:, ::-1][:, :wanted]
    deviation = [int((r * r).sum()) for r in whole]
    return [i for i, _ in kept], deviation, centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n), n


def check_whitening(rows, got):
    ids, deviation, z, explained, n = plain_whitening(rows)
    m = z.shape[1]
    assert len(got) == len(ids) * m
    by_row = collections.defaultdict(list)
    for r in got:
        by_row[r.vec_id].append(r)
    signs = None
    for i, (vec_id, d) in enumerate(zip(ids, deviation, strict=True)):
        mine = sorted(by_row[vec_id], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, m + 1))
        assert {(r.n, r.deviation) for r in mine} == {(n, d)}
        w = np.array([r.whitened for r in mine])
        signs = np.sign(w) * np.sign(z[i]) if signs is None else signs
        assert np.allclose(w, signs * z[i], atol=1e-7)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9)
        assert max(r.identity_error for r in mine) < 1e-9


def test_whitening_equals_the_eigenvectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check_whitening(rows, whitening.whitened_rows(df).collect())


def test_hard_vectors(spark):
    draw = np.random.default_rng(5)
    good = [(i, [float(c) for c in draw.standard_normal(5) * [5, 4, 3, 2, 1]]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, []), (105, [1.0, 2.0])]
    schema = "vec_id bigint, embedding array<float>, x string, n int, component int"
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in good + bad], schema)
    check_whitening(good, whitening.whitened_rows(df).collect())
    for same in ([], good[:1], [(i, [1.0, 2.0]) for i in range(9)], bad):
        assert whitening.whitened_rows(spark.createDataFrame([(i, v, "", 0, 0) for i, v in same], schema)).collect() == []
    # one direction only, and large entries whose squares leave 64 bits
    line = spark.createDataFrame([(i, [float(i) * 2**20, 0.0, float(i) * 2**20]) for i in range(64)], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and max(r.deviation for r in got) == 2 * (64 * 2**26 * 63 - sum(range(64)) * 2**26) ** 2


@pytest.mark.parametrize("shape", ["flat", "falling", "equal", "thin"])
def test_bidiagonalisation(shape):
    draw = np.random.default_rng(1)
    x = draw.standard_normal((400, 24))
    if shape == "falling":
        x = x * 0.5 ** np.arange(24)
    if shape == "equal":
        x = np.repeat(np.eye(24), 10, axis=0)
    if shape == "thin":
        x = x[:, :5] @ draw.standard_normal((5, 24))
    x = x - x.mean(axis=0)
    steps = []

    def products(y):
        steps.append(1)
        t = x @ y
        return t @ x, t @ t, (x * x).sum()

    axes, squares, total = whitening.bidiagonalise(products, 24, 8)
    m = min(8, int((squares > 1e-13 * squares[0]).sum()))
    truth = np.linalg.svd(x, compute_uv=False) ** 2
    assert np.allclose(squares[:m], truth[:m], rtol=1e-10) and m == min(8, int((truth > 1e-13 * truth[0]).sum()))
    assert np.allclose(axes @ axes.T, np.eye(len(axes)), atol=1e-12)
    z = x @ axes[:m].T / np.sqrt(squares[:m])
    assert np.allclose(z.T @ z, np.eye(m), atol=1e-9)
    assert len(steps) < 24 if shape == "falling" else len(steps) <= 24


# --- 13

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_secrets(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans)


def base_found(text):
    compiled = {r.version: r.compiled() for r in secret_scan.BASE}
    place = {r.version: i for i, r in enumerate(secret_scan.BASE)}
    return sorted((a, place[v], b) for v, a, b in secret_scan.find(text, secret_scan.BASE, compiled))


@QUICK
@given(st.lists(st.sampled_from(["token", "TOKEN", "api_key", "apiKey", "=", ":", " ", '"', "abc", "f" * 12, "0" * 13, "AKIA", "Z9" * 9, "ſecret", "é", "\n"]), max_size=14))
def test_base_kinds_equal_the_plain_patterns(parts):
    text = "".join(parts)
    assert base_found(text) == plain_secrets(text)


def test_secret_digests(spark, docs, texts):
    got = {r.doc_id: r for r in secret_scan.secrets(docs).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        plain = plain_secrets(texts[i] or "")
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in plain)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == c for _, k, _ in plain) for c in range(3))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r.spans.split(",")) | {""}


def test_only_unseen_pairs_are_scanned(spark):
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "test-ledger"))
    secret, other = "token = abcdef123", "nothing"
    first = spark.createDataFrame([("a", 1, secret), ("b", 1, secret), ("c", 1, other)], "path string, commit int, text string")
    base = list(secret_scan.BASE)

    def pairs():
        return sorted((bytes(r.blob).hex(), v) for r in ledger.read().collect() for v in r.rules)

    secret_scan.scan(first, ledger, rules=base, told_by=("commit",))
    assert len(pairs()) == 2 * len(base) == len(set(pairs()))
    # a later version of one path, an old content under a new path, and again everything seen
    second = spark.createDataFrame([("a", 2, "password: hunter2hunter2"), ("d", 2, secret), ("c", 2, other)], first.schema)
    secret_scan.scan(first.unionByName(second), ledger, rules=base, told_by=("commit",))
    assert len(pairs()) == 3 * len(base) == len(set(pairs()))
    secret_scan.scan(second, ledger, rules=base, told_by=("commit",))
    assert len(pairs()) == 3 * len(base)
    # a new rule reads old blobs, and only it does
    extra = secret_scan.Rule("word", r"nothing")
    places = secret_scan.scan(first.unionByName(second), ledger, rules=[*base, extra], told_by=("commit",))
    assert len(pairs()) == 3 * (len(base) + 1) == len(set(pairs()))
    found = secret_scan.findings(ledger.read(), [*base, extra])
    rows = places.join(found, "blob").collect()
    kinds = collections.Counter((r.path, s.kind) for r in rows for s in r.spans)
    assert kinds == {("a", "assign"): 2, ("b", "assign"): 1, ("d", "assign"): 1, ("c", "word"): 2}
    # a changed rule is another version; the old one's findings stay
    changed = secret_scan.Rule("word", r"no")
    secret_scan.scan(first, ledger, rules=[*base, changed])
    again = {s for r in secret_scan.findings(ledger.read(), [changed]).collect() for s in [tuple(x)[:3] for x in r.spans]}
    assert again == {("word", 0, 2)}


def test_a_stopped_append_leaves_the_ledger_as_it_was(spark):
    ledger = secret_scan.Ledger(spark, scratch_path(spark, "test-ledger"))
    df = spark.createDataFrame([("a", "token = abcdef123")], "path string, text string")
    secret_scan.scan(df, ledger)
    before = ledger.read().count()
    ledger.read().limit(1).write.parquet(f"{ledger.path}/_run-stopped")  # written, never renamed
    assert ledger.read().count() == before == 1


@pytest.mark.parametrize("name", ["op11_spelling", "op13_secrets"])
def test_hard_rows_and_empty_tables(spark, hard, empty, tmp_path, name):
    for df, n in ((hard, len(HARD)), (empty, 0)):
        folder = str(tmp_path / f"{name}{n}")
        df.write.parquet(f"{folder}/documents.parquet")
        got = queries.QUERIES[name](spark, folder).collect()
        if name == "op13_secrets":
            assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _, _ in HARD[:n])
        else:
            assert {tuple(r) for r in got} == plain_variants(plain_words([(i, t) for i, t, _ in HARD[:n]]))


@pytest.mark.parametrize("function", ["stages", "remove_repeats", "keep_one_similar"])
def test_clashing_names_pass_through(spark, tmp_path, function):
    """Every stage over columns with the operators' own names, a dotted name, null and repeated rows, and no rows."""
    own = ["row_key", "__key", "__doc", "__id", "__fp", "a.b", "wanted_key", "copy_key", "fp", "row"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in own)
    rows = [(i, t, g, "s", 0, *own) for i, t, g in HARD]
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "no id here " * 5)], "item_id bigint, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        if function == "stages":
            outs = [stage(spark, df, str(tmp_path)) for _, stage in corpus_pipeline.STAGES[:-1]]
        elif function == "remove_repeats":
            outs = [lines.remove_repeats(df).drop("removed_spans")]
        else:
            outs = [simhash.keep_one_similar(df)]
        for out in outs:
            assert out.columns == df.columns
            assert {tuple(r)[5:] for r in out.collect()} <= {tuple(own)}
