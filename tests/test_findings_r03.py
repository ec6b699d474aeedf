import ast
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import tokenizers

from millrace.llm import bpe, lines, queries
from millrace.operators import duplicates as du


def test_texts_with_too_little_in_common_are_no_candidates(spark, monkeypatch):
    """Every two texts share one word of their own, in both prefixes, which is not enough to look at their sets."""
    texts = [(i, " ".join(f"s p{min(i, j)}x{max(i, j)}" for j in range(10) if j != i)) for i in range(10)]
    texts += [(10 + i, "one two three four five six seven " + w) for i, w in enumerate(("eight", "nine"))]
    frame = spark.createDataFrame(texts, "id bigint, text string")
    asked, links = [], du._Prefixes.links

    def counted(self, pairs):
        asked.append(pairs.count())
        return links(self, pairs)

    monkeypatch.setattr(du._Prefixes, "links", counted)
    assert [(r.member, r.leader) for r in du.near_duplicates(frame).collect()] == [(11, 10)]
    assert asked == [1]
    assert [(r.member, r.leader) for r in du.group_links(frame).collect()] == [(11, 10)]
    assert asked == [1, 1, 0]


def test_blocks_are_found_without_a_look_at_expressions():
    code = (
        "try:\n  if a:\n    x = f(1, [b for b in c])\nexcept E:\n  for i in j:\n    with k:\n      pass\nelse:\n  while 1:\n    pass\n"
        "finally:\n  def f(): pass\nmatch q:\n  case 1:\n    class C:\n      if 2: pass\n"
    )
    tree = ast.parse(code)
    seen = list(du._statements(tree))
    blocks = [n for n in ast.walk(tree) if isinstance(n, du.BLOCK_KINDS)]
    assert [n for n in seen if isinstance(n, du.BLOCK_KINDS)] == blocks and len(blocks) == 7
    assert not any(isinstance(n, ast.expr) for n in seen)


def test_passages_inside_lines_go(spark, tmp_path):
    """A passage of 52 words in the middle of two lines; the words around it differ, and a repeated line stays a unit."""
    passage = ", ".join(f"p{w}a p{w}b p{w}c p{w}d" for w in "abcdefghijklm") + "."
    line = " ".join(f"l{w}" for w in "abcdefghijklmnop")
    texts = [f"One two, three. {passage} And\u0301 so on.\n{line}", f"{line}\nFour. {passage} five 1.5, six.", f"Seven, {passage}\n{line} eight", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_lines(spark, str(tmp_path)).collect()}
    assert [(got[i].n_repeated_passages > 0, got[i].n_removed) for i in range(4)] == [(True, 0), (True, 2), (True, 1), (False, 0)]
    assert [got[i].n_repeated for i in range(4)] == [1, 1, 0, 0]
    cut = {r.doc_id: r.text for r in lines.remove_repeats(frame, passage_words=lines.PASSAGE_WORDS).collect()}
    assert cut == {0: texts[0], 1: "\nFour.  five 1.5, six.", 2: f"Seven, \n{line} eight", 3: ""}
    assert lines.remove_repeats(frame).where("doc_id = 2").first().text == texts[2]


def test_spans_of_both_kinds_of_units_against_plain_code(spark):
    """Units of lines hold units of clauses; what overlaps is one span."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc") + rng.choice((" ", " ", ", ", ". ", "\n", ",")) for _ in range(rng.randrange(40))) for _ in range(60)]
    kinds = [(lines.units_of(t, min_words=4), lines.units_of(t, "clause", 3)) for t in texts]
    units = [of_lines + of_clauses for of_lines, of_clauses in kinds]
    first, times = {}, {}
    for i, (a, _, d) in sorted((i, (a, b, d)) for i, us in enumerate(units) for d, a, b in us):
        first.setdefault(d, (i, a))
        times[d] = times.get(d, 0) + 1
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in lines.line_repeats(frame, 4, 3).collect():
        spans = []
        for a, b in sorted((a, b) for d, a, b in units[r.doc_id] if first[d] != (r.doc_id, a)):
            if spans and a < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        assert r.removed == ",".join(f"{a}:{b}" for a, b in spans)
        of_lines, of_clauses = ((len(us), sum(times[d] > 1 for d, _, _ in us)) for us in kinds[r.doc_id])
        assert (r.n_units, r.n_repeated) == of_lines and (r.n_passages, r.n_repeated_passages) == of_clauses


def test_clauses_hold_all_words():
    for text in ("a, b.c d... e;\nf  g.\n\n ,h 1.5! i", "x", "...", " \n", "\u00e9t\u00e9. \u2003b,\tc\r\nd"):
        clauses = [m.group() for m in lines._UNITS["clause"].finditer(text)]
        assert [w for c in clauses for w in c.split()] == text.split()
    assert [m.group() for m in lines._UNITS["clause"].finditer("a, b.c d... e\nf 1.5")] == ["a,", "b.c d...", "e", "f 1.5"]


TEXTS = ["", " ", "A b\x1cc  d\n", "\x85x\xa0y\u2003z\u3000", None, "na\u00efve <|endoftext|>a<|endoftext|> it's 12.5!", "\u0e01\u0e33 \u65e5\u672c \U0001f600", "one one One, one"] * 2


def test_ids_of_many_texts_in_a_row(spark):
    """Empty texts, blanks of all kinds and special tokens, encoded as the library does and read back."""
    path = queries.tokenizer_path()
    library = tokenizers.Tokenizer.from_file(path)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").coalesce(1)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    for docs in (frame, frame.where("doc_id < 2")):
        encoded = bpe.encode(docs, path)
        got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() if r.ids else [] for r in encoded.collect()}
        assert got == {r.doc_id: want[r.doc_id] for r in docs.collect()}
        digests = {r.doc_id: r for r in bpe.round_trip_digests(docs, path).collect()}
        for r in bpe.decode(encoded, path).collect():
            assert r.text == library.decode(want[r.doc_id], skip_special_tokens=False)
            assert digests[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
            assert digests[r.doc_id].ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()


def test_slices_are_encoded_and_counted_by_distinct_pieces(spark, monkeypatch):
    """A piece is looked at once for a slice of texts, not once for each place it stands at."""
    own = bpe.Tokenizer(queries.tokenizer_path())
    split = own.split(pa.array([t or "" for t in TEXTS]))
    assert [[c for c in s if c] for s in split.to_pylist()] == [[c for c in own.chunks(t or "") if c] for t in TEXTS]
    monkeypatch.setattr(bpe, "COUNTED", 20)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    words = Counter(w for t in TEXTS for c in own.chunks(t or "") for w in own.words(c) if isinstance(w, bytes))
    assert {bytes(r.word): r.n for r in bpe.count_words(frame, own.path).collect()} == words
