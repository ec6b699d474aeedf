"""Parent-child hierarchies: recursive common table expressions and CONNECT BY."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.hotkeys import spread_join
from millrace.session import materialize


def hierarchy(
    nodes: DataFrame,
    node: str,
    parent: str,
    start: Column,
    max_level: int | None = None,
) -> DataFrame:
    """(node, parent, level, root, path) of all nodes below those where ``start`` holds.

    Each level is one join of the nodes to the level above, written to the shared folder,
    so no level is computed twice and the plan does not grow with the depth. A node that
    is already on its own path is not entered again.
    """
    edges = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    level = nodes.where(start).select(
        F.col(node).alias("node"),
        F.col(parent).alias("parent"),
        F.lit(1).alias("level"),
        F.col(node).alias("root"),
        F.array(F.col(node)).alias("path"),
    )
    level = materialize(level, "level")
    levels, depth = [level], 1
    while max_level is None or depth < max_level:
        depth += 1
        above = level.select(F.col("node").alias("up"), "root", "path")
        below = edges.join(above, edges["parent"] == above["up"], "inner").where(
            ~F.array_contains("path", F.col("node"))
        )
        level = materialize(
            below.select(
                "node",
                "parent",
                F.lit(depth).alias("level"),
                "root",
                F.concat("path", F.array("node")).alias("path"),
            ),
            "level",
        )
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionAll, levels)


def levels(nodes: DataFrame, node: str, parent: str, start: Column) -> DataFrame:
    """(node, parent, level, root, cyclic) of a forest, in as many rounds as the depth has binary digits.

    For trees too deep for a job per level. Every node points to an ancestor and knows how far it is; a
    round replaces the pointer by that ancestor's own, which doubles the distance, until it ends at a start.
    A parent with very many children is spread, and only nodes that have not arrived take part in a round.

    A node has one parent: repeated equal rows count once, a node with two parents is an error. A start
    below another start begins a tree of its own. Nodes on or under a cycle without a start are ``cyclic``
    and have neither level nor root; nodes that lead to no start otherwise (null or unknown parent) have
    no row, as in ``hierarchy``. A null node is no one's parent.
    """
    starts = F.coalesce(start, F.lit(False))
    first = nodes.select(
        F.col(node).alias("node"),
        F.col(parent).alias("parent"),
        F.when(starts, F.col(node)).otherwise(F.col(parent)).alias("up"),
        F.when(starts, 0).otherwise(1).cast("bigint").alias("distance"),
        (~starts).alias("open"),
    )
    first = materialize(first.distinct(), "pointers")
    twice = first.where("node IS NOT NULL").groupBy("node").count().where("count > 1").select("node").first()
    if twice:
        raise ValueError(f"node {twice['node']} has more than one parent; use hierarchy")
    arrived, waiting = first.where("NOT open"), first.where("open")
    left = waiting.count()
    while left:
        ancestors = arrived.unionAll(waiting).select(
            F.col("node").alias("at"), F.col("up").alias("further"), F.col("distance").alias("more"), F.col("open").alias("still")
        )
        met = spread_join(waiting, ancestors, [("up", "at")], right_unique=True)
        moved = met.select("node", "parent", F.col("further").alias("up"), (F.col("distance") + F.col("more")).alias("distance"), F.col("still").alias("open"))
        moved = materialize(moved, "pointers")
        arrived, waiting = arrived.unionAll(moved.where("NOT open")), moved.where("open")
        before, left = left, waiting.count()
        # every round ends at least one pointer that can end
        if left == before:
            break
    ended = arrived.select("node", "parent", (F.col("distance") + 1).alias("level"), F.col("up").alias("root"), F.lit(False).alias("cyclic"))
    rest = waiting.select("node", "parent", F.lit(None).cast("bigint"), F.lit(None).cast(first.schema["up"].dataType), F.lit(True))
    return ended.unionAll(rest)
