"""Connected components by alternating large-star and small-star joins.

Nodes are any orderable keys; every key is replaced by the smallest key it can
reach. The edges are written to the shared folder twice a round, so a lost
executor costs one round at most, and the rounds end when the edges are stars.
A node that a third of all edges touch is reduced to its smallest neighbour by
a partial aggregate; the joins read plain shuffles on both sides, so adaptive
execution can split that node's edges over tasks. Neighbour lists are never
collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, release


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` ``(a, b)``; ``component`` is the smallest key reachable."""
    now = cut(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    for _ in range(max_rounds):
        if _stars(now):
            break
        # large star: neighbours above a node go to the smallest key of its neighbourhood
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_smallest(both), F.col("a") == F.col("k")).where("b > a")
        large = cut(large.select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        # small star: a node and its smaller neighbours go to the smallest of them
        small = large.join(_smallest(large), F.col("a") == F.col("k"))
        moved = F.explode(F.array(F.col("a"), F.col("b"))).alias("a")
        now = cut(small.select(moved, F.col("m").alias("b")).where("a != b").distinct())
        release(edges.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _smallest(edges: DataFrame) -> DataFrame:
    """``(k, m)``: each node and its smallest neighbour. The key is an aggregate of its
    own, so a join on it shuffles this side anew instead of leaning on the aggregate's
    partitioning, which would keep adaptive execution from splitting a hot key."""
    return edges.groupBy("a").agg(F.max("a").alias("k"), F.min("b").alias("m")).select("k", "m")


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none of these has one itself."""
    one, none = F.lit(1).alias("below"), F.lit(0).alias("below")
    ends = edges.select(F.col("a").alias("k"), one).unionAll(edges.select(F.col("b").alias("k"), none))
    below = ends.groupBy("k").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    return below.where("below > 1 or (below = 1 and least = 0)").isEmpty()
