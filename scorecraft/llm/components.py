"""Connected components of an edge table by alternating large and small stars.

Nothing is collected: each round rewrites the edges with grouped minima, and
the loop ends when a round changes no edge.  The number of rounds follows the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecraft.llm.hot import join_counted
from scorecraft.llm.storage import cut


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return (join_counted(both, low, ["a"], 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(low, "a")
    return (near.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another node; component
    is the smallest node reachable.  Loops and repeated edges are harmless."""
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    state, n = None, now.count()
    while True:
        large = cut(_large_star(now, n), instead_of=now)         # read three times by the small star's plan
        now = cut(_small_star(large), instead_of=large)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        n = found[0]
        if tuple(found) == state:
            break
        state = tuple(found)
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
