"""Connected components of links between integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, root): every id that occurs in (a, b) with the smallest id it is connected to.

    Each round an id takes the smallest root among its neighbours', and then the root of that root,
    so the rounds grow with the logarithm of the longest chain. Roots are grouped pre-aggregated and
    joined as one row per id; a neighbour of very many ids is split by adaptive execution. Every
    round's table lies in the shared folder.
    """
    both = links.select("a", "b").where("a <> b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "links")
    roots = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "id").select("id", "root", F.least("root", "near").alias("next"))
        jump = roots.select(F.col("id").alias("next"), F.col("root").alias("further"))
        moved = lower.join(jump, "next").select("id", "root", F.least("next", "further").alias("next"))
        moved = materialize(moved, "roots")
        if moved.where("root <> next").isEmpty():
            return moved.select("id", "root")
        roots = moved.select("id", F.col("next").alias("root"))
