import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import hierarchy as hi


def found(spark, data, start="parent IS NULL", schema="id long, parent long"):
    df = spark.createDataFrame(data, schema)
    return {r.node: (r.level, r.root, r.cyclic) for r in hi.levels(df, "id", "parent", F.expr(start)).collect()}


def by_hand(parents, starts):
    out = {}
    for node in parents:
        at, level, seen = node, 1, set()
        while at in parents and at not in starts and at not in seen:
            seen.add(at)
            at, level = parents[at], level + 1
        if at in starts:
            out[node] = (level, at, False)
        elif at in seen:
            out[node] = (None, None, True)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_with_cycles_and_unknown_parents(spark, seed):
    rng = random.Random(seed)
    parents = {i: rng.choice([None, rng.randrange(120), rng.randrange(130), i - 1, i - 1, i - 1]) for i in range(120)}
    starts = {i for i, p in parents.items() if p is None and i % 3} | {7, 50}
    listed = ",".join(map(str, starts))
    assert found(spark, list(parents.items()), f"id IN ({listed})") == by_hand(parents, starts)


def test_a_chain_of_ten_thousand_takes_fourteen_rounds(spark, monkeypatch):
    rounds, write = [], hi.materialize
    monkeypatch.setattr(hi, "materialize", lambda df, label: rounds.append(label) or write(df, label))
    nodes = spark.range(10_000).selectExpr("id", "nullif(id, 0) - 1 AS parent")
    out = hi.levels(nodes, "id", "parent", F.col("id") == 0)
    assert out.where("level = node + 1 AND root = 0 AND NOT cyclic").count() == 10_000
    assert len(rounds) == 1 + 14  # the first pointers, then the rounds


def test_one_parent_of_most_nodes(spark):
    nodes = spark.range(30_000).selectExpr("id", "CASE WHEN id = 0 THEN NULL WHEN id < 20000 THEN 0 ELSE id - 20000 END AS parent")
    out = hi.levels(nodes, "id", "parent", F.col("parent").isNull())
    assert {(r.level, r["count"]) for r in out.groupBy("level").count().collect()} == {(1, 1), (2, 20_000), (3, 9_999)}


def test_nulls_repeated_rows_and_empty_tables(spark):
    data = [(1, None), (1, None), (2, 1), (2, 1), (None, 2), (3, 99), (4, 3), (5, 5), (6, 5)]
    wanted = {1: (1, 1, False), 2: (2, 1, False), None: (3, 1, False), 5: (None, None, True), 6: (None, None, True)}
    assert found(spark, data) == wanted
    assert found(spark, []) == {}
    assert found(spark, [(1, 2), (2, 1)], "CAST(NULL AS BOOLEAN)") == {1: (None, None, True), 2: (None, None, True)}
    with pytest.raises(ValueError, match="node 2"):
        found(spark, [(1, None), (2, 1), (2, 3), (3, 1)])


def test_text_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "a", 2)], "up string, distance string, node int")
    got = hi.levels(df, "up", "distance", F.col("distance").isNull()).collect()
    assert sorted((r.node, r.parent, r.level, r.root) for r in got) == [("a", None, 1, "a"), ("b", "a", 2, "a")]
