"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.scratch import free, small, stored

#: Edges from which a node counts as wide.
WIDE = 1_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest id reachable along ``edges`` (a, b).

    Each round joins every node's neighbours to the smallest of them; the number of rounds grows with
    the logarithm of the longest chain. Nodes without an edge to another node do not occur.
    """
    now = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "lowest")
        # A centre with many edges meets them where they are; only the edges of other nodes are shuffled by node.
        wide = both.join(small(low.where(F.col("n") > WIDE).select("a", "m")), "a", "left")
        narrow = wide.where("m is null").select("a", "b").join(low.where(F.col("n") <= WIDE).select("a", "m"), "a")
        large = wide.where("m is not null").select("a", "b", "m").unionByName(narrow)
        large = large.where("b > a").select(F.col("m").alias("a"), "b")
        large = large.where("a != b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        lesser = large.join(least, "b").select("m", "b", "a")
        after = lesser.select(F.col("m").alias("a"), "b").unionAll(lesser.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
        after = stored(after, "edges")
        # Done when each node has one edge, and to a node that has none upwards: a star forest.
        deep = after.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        deep = deep or after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        free(now, low)
        now = after
        if not deep:
            break
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(roots)
