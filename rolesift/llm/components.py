"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.session import materialize, release


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of the links ``(a, b)``; root is the least node it reaches.

    Each round hangs every node on its least neighbour, follows parents to their
    root by pointer jumping, and contracts the links to roots. Stars, the usual
    shape, need one round. Every step is a shuffle join or a combined aggregate over
    tables in the shared folder; nothing but counts reaches the driver.
    """
    edges = materialize(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    )
    both = edges.select("a").union(edges.select("b")).distinct()
    roots = materialize(both.select(F.col("a").alias("node"), F.col("a").alias("root")))
    while edges.limit(1).count():
        ends = edges.union(edges.select("b", "a"))
        parents = materialize(
            ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        )
        while True:
            up = parents.select(F.col("node").alias("p"), F.col("p").alias("next"))
            jumped = materialize(parents.join(up, "p").select("node", F.col("next").alias("p"), (F.col("next") != F.col("p")).alias("moved")))
            moved = jumped.filter("moved").limit(1).count()
            release(parents)
            parents = jumped.drop("moved")
            if not moved:
                break
        to = parents.select(F.col("node").alias("root"), F.col("p").alias("top"))
        fresh = materialize(roots.join(to, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        release(roots)
        roots = fresh
        left = edges.join(parents.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(
            parents.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b"
        )
        fewer = materialize(
            left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct()
        )
        release(edges, parents)
        edges = fewer
    release(edges)
    return roots
