import difflib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import duplicates as du, hierarchy as hi, history as hs
from tests.conftest import rows

CODE = """
def load(path):
    df = spark.read.csv(path, header=True)
    for c in df.columns:
        if c == "a":
            print(c)
    return df
"""


def blocks_of(spark, *codes):
    df = spark.createDataFrame(list(enumerate(codes)), "id int, content string")
    return du.code_blocks(df, "id")


def test_blocks_have_their_lines(spark):
    got = rows(blocks_of(spark, CODE, "def broken(:", "", "x = 1"), "kind", "start_line", "end_line")
    assert got == [("For", 4, 6), ("FunctionDef", 2, 7), ("If", 5, 6)]


def test_fingerprints_ignore_constants_and_bodies(spark):
    prints = {}
    codes = ["for i in range(3):\n    a()", "for i in range(99):\n    b()", "for i in range('x'):\n    a()", "for j in range(3):\n    a()"]
    for r in blocks_of(spark, *codes).collect():
        prints[r.id] = r.fingerprint
    assert prints[0] == prints[1] and len({prints[0], prints[2], prints[3]}) == 3


def test_fingerprint_of_an_inner_block_does_not_depend_on_the_outer(spark):
    inner = "while x:\n    def f(a):\n        return 1\n    y = 2"
    outer = "class C:\n    def g(self):\n        pass\n    " + inner.replace("\n", "\n    ")
    by_kind = lambda code: {r.kind: r.fingerprint for r in blocks_of(spark, code).where("kind = 'While'").collect()}
    assert by_kind(inner) == by_kind(outer)


def test_pattern_records(spark):
    codes = [f"def load(path):\n    src_{n} = read(path)\n    return src_{n}" for n in (1, 2, 2, 3)]
    records, varying = du.pattern_records(blocks_of(spark, *codes), "id")
    r = records.first()
    assert r.usage_count == 4 and r.parameters == ["src_1"] and len(r.examples) == 3
    assert r.template == codes[0].replace("src_1", "{src_1}")
    assert rows(varying, "token", "n") == [("src_1", 1), ("src_2", 2), ("src_3", 1)]


@pytest.fixture(scope="module")
def few_texts(spark, tables):
    blocks = du.text_blocks(tables.documents.where("doc_id < 60"))
    return blocks.groupBy("text").agg(F.min("block_id").alias("id"))


def word_pairs(text):
    words = text.lower().split(" ")
    return set(zip(words, words[1:])) or {(words[0], "")}


def all_similar(texts, share=0.6):
    """{(member, leader): ratio} of all pairs, one by one."""
    sets = {i: word_pairs(t) for i, t in texts.items() if t is not None}
    found = {}
    for a in sets:
        for b in sets:
            ratio = 2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b]))
            if a > b and ratio >= share:
                found[a, b] = ratio
    return found


def joined(links):
    """{id: smallest id reached} of the ids in links."""
    label = {i: i for pair in links for i in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_near_duplicates_against_all_pairs(few_texts):
    texts = {r.id: r.text for r in few_texts.collect()}
    found = {(r.member, r.leader): r.ratio for r in du.near_duplicates(few_texts).collect()}
    assert found and found == all_similar(texts)
    # the share of word pairs stands for eight in ten matching characters
    similar = set()
    for a in texts:
        matcher = difflib.SequenceMatcher(None, "", texts[a], autojunk=False)
        for b in texts:
            if a < b and 2 * min(len(texts[a]), len(texts[b])) >= 0.8 * (len(texts[a]) + len(texts[b])):
                matcher.set_seq1(texts[b])
                if matcher.quick_ratio() >= 0.8 and difflib.SequenceMatcher(None, texts[a], texts[b], autojunk=False).ratio() >= 0.8:
                    similar.add((b, a))
    long = {(b, a) for b, a in similar if min(len(texts[a].split()), len(texts[b].split())) > 4}
    assert long and len(long & set(found)) >= 0.9 * len(long)


@pytest.mark.parametrize("words", [3, 40])
def test_random_texts_in_large_buckets(spark, words):
    """Few words: nearly all texts meet. Many links, repeated texts, empty and null ones."""
    rng = np.random.default_rng(words)
    texts = {i: " ".join(f"w{w}" for w in rng.integers(0, words, rng.integers(1, 9))) for i in range(150)}
    texts |= {150: "", 151: None, 152: "W1 w2", 153: " ".join(f"w{i % 7}" for i in range(3000))}
    frame = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    expected = all_similar(texts)
    assert {(r.member, r.leader): r.ratio for r in du.near_duplicates(frame).collect()} == expected
    chains = {(r.member, r.leader): r.ratio for r in du.group_links(frame).collect()}
    assert chains.items() <= expected.items()
    assert joined(chains) == joined(expected)
    groups = dict(rows(du.similar_groups(frame.withColumnRenamed("id", "block_id"))))
    assert {i: g for i, g in groups.items() if i in joined(expected)} == joined(expected)


def test_chains_in_one_bucket_are_one_group(spark):
    """A ~ B ~ C, A and C unlike, all sharing word pairs, whichever of them has the smallest id."""
    texts = {}
    for n, order in enumerate(itertools.permutations(range(3))):
        words = [f"{n}x{i}" for i in range(30)]
        chain = [words[0:20], words[5:25], words[10:30]]
        texts |= {10 * n + place: " ".join(chain[i]) for place, i in enumerate(order)}
    assert len(all_similar(texts)) == 12  # two of three pairs each
    frame = spark.createDataFrame(list(texts.items()), "block_id bigint, text string")
    assert dict(rows(du.similar_groups(frame))) == {i: i // 10 * 10 for i in texts}


def test_a_family_of_near_copies_is_grouped_by_few_links(spark):
    base = " ".join(f"base{i}" for i in range(30))
    texts = [(i, f"{base} own{i}") for i in range(400)] + [(400 + i, f"base0 base1 other{i} word{i} left{i}") for i in range(400)]
    frame = spark.createDataFrame(texts, "id bigint, text string")
    links = du.group_links(frame)
    assert links.count() < 4000  # all pairs of the family are 79,800
    assert dict(rows(du.components(links), "id", "group_id")) == {i: 0 for i in range(400)}


def test_unlike_texts_with_a_common_pair_do_not_meet(spark):
    frame = spark.range(3000).selectExpr("id", "concat('in common a', id, ' b', id, ' c', id, ' d', id) AS text")
    assert du._Prefixes(frame, du.pair_share(0.8)).places.count() == 0


def test_similarity_has_a_range():
    assert du.pair_share(0.8) == 0.6 and du.pair_share(1) == 1
    with pytest.raises(ValueError, match="similarity"):
        du.pair_share(0.5)


def test_ids_of_lines_do_not_collide(spark):
    """A document of more than a million lines beside the next one."""
    df = spark.range(2).selectExpr("id AS doc_id", "IF(id = 0, repeat('x\n', 1000003), 'y\nz') AS text")
    blocks = du.text_blocks(df)
    assert blocks.count() == blocks.select("block_id").distinct().count() == 1_000_005


def test_no_candidates(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "x y z")], "id bigint, text string")
    assert du.near_duplicates(df).count() == 0 and du.group_links(df).count() == 0
    assert du.similar_groups(df.limit(0).withColumnRenamed("id", "block_id")).count() == 0


def test_components_of_chains_and_rings(spark):
    edges = [(i + 1, i) for i in range(1, 40)] + [(101, 100), (102, 101), (100, 102)] + [(201, 200)]
    df = spark.createDataFrame(edges, "member bigint, leader bigint")
    got = dict(rows(du.components(df), "id", "group_id"))
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in (100, 101, 102)}, 200: 200, 201: 200}


def test_similar_groups_hold_equal_texts_together(spark):
    long = "the quick brown fox jumps over the lazy dog near the river bank every morning"
    df = spark.createDataFrame(
        [(1, long), (2, long), (3, long + " again"), (4, "unlike"), (5, "twice"), (6, "twice")], "block_id bigint, text string"
    )
    assert dict(rows(du.similar_groups(df))) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_pattern_store_adds_up(spark):
    schema = "block_id bigint, text string"
    first = du.pattern_batch(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema))
    second = du.pattern_batch(spark.createDataFrame([(4, "a"), (5, "c")], schema))
    store = du.store_patterns(first, second)
    assert rows(store, "template", "usage_count", "last_seen") == [("a", 3, 4), ("b", 1, 3), ("c", 1, 5)]
    assert [r.template for r in du.common_patterns(store).collect()] == ["a"]
    assert [r.template for r in du.search_patterns(store, "C").collect()] == ["c"]


# --- hierarchies -------------------------------------------------------------------


def test_hierarchy_equals_recursive_sql(spark, tables):
    nodes = tables.customer.selectExpr("c_custkey AS id", "nullif(c_custkey, 0) AS k").selectExpr(
        "id", "CASE WHEN k IS NOT NULL THEN cast(floor(k / 10) AS bigint) END AS parent"
    )
    native = spark.sql(
        "WITH RECURSIVE w AS (SELECT id, 1 AS level FROM {n} WHERE parent IS NULL "
        "UNION ALL SELECT n.id, w.level + 1 FROM {n} n JOIN w ON n.parent = w.id) SELECT * FROM w",
        n=nodes,
    )
    mine = hi.hierarchy(nodes, "id", "parent", F.col("parent").isNull())
    assert rows(mine, "node", "level") == rows(native, "id", "level")


def test_hierarchy_does_not_run_round_in_circles(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 3)], "id int, parent int")
    got = hi.hierarchy(df, "id", "parent", F.col("id") == 1)
    assert rows(got, "node", "level") == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert hi.hierarchy(df, "id", "parent", F.col("id") == 1, max_level=2).count() == 2


# --- history -----------------------------------------------------------------------


def test_a_bad_row_gives_an_error_row(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "id int, v string")
    got = {r.id: (r.result, r.error) for r in hs.run_each(df, "id", "v", int).collect()}
    assert got == {1: ("4", None), 2: (None, "ValueError"), 3: (None, "TypeError")}


def test_store_and_look_up(spark):
    old = spark.createDataFrame([(1, "SELECT 1"), (2, "SELECT 2")], "at int, sql string")
    new = spark.createDataFrame([(3, " select 1 ")], "at int, sql string")
    stored = hs.store_results(old, new, "sql", [("at", False)])
    assert rows(stored, "at") == [(2,), (3,)]
    batch = spark.createDataFrame([(9, "Select 2"), (8, "Select 3")], "n int, sql string")
    assert rows(hs.look_up(batch, stored, "sql", ["at"]), "n", "hit") == [(8, False), (9, True)]


def test_effectiveness_is_zero_without_a_match(spark):
    df = spark.createDataFrame([("broadcast", 2.0), ("Broadcast hint", 4.0)], "label string, v double")
    assert tuple(hs.effectiveness(df, "label", "v", "broadcast").first()) == (3.0, 2.0, 4.0, 2)
    assert tuple(hs.effectiveness(df, "label", "v", "cache").first()) == (0.0, 0.0, 0.0, 0)


def test_flaky_needs_three_runs_and_both_results(spark):
    data = [("f", i, i % 2 == 0) for i in range(6)] + [("ok", i, False) for i in range(6)]
    data += [("few", 0, True), ("few", 1, False)] + [("bad", i, i > 0) for i in range(10)]
    df = spark.createDataFrame(data, "name string, at int, failed boolean")
    got = hs.flaky_names(df, "name", "failed", [("at", False)]).collect()
    assert [(r.name, r.failure_rate, r.last_results) for r in got] == [("f", 0.5, "passed,failed,passed,failed,passed")]
