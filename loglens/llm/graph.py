"""Connected components by alternating large-star and small-star steps.

Every step is a groupBy with map-side combine and a join that deals the edges of a hub to several tasks, the more the
larger the hub is; nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_counted, materialise


def _with_least(edges: DataFrame, of: DataFrame, total: int) -> DataFrame:
    """``edges`` with the least b that their a has among the edges ``of``, as m; both uses of the counts share one shuffle."""
    return join_counted(edges, of.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "a", "n", ["b"], total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both.filter("b > a"), both, 2 * total).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _with_least(down, down, total).filter("b <> m").select("b", "m").toDF("a", "b")
    return moved.unionByName(down.groupBy("a").agg(F.min("b").alias("b")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its least node.

    ``edges`` has columns a and b of one ordered type; loops are ignored, repeated edges and both directions
    are allowed.  An edge list without rows gives none.
    """
    now = materialise(edges.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, size = None, now.count()
    for _ in range(rounds):
        now = materialise(_small_star(_large_star(now, size), size).filter("a <> b").distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark, size = seen, seen[0]
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
