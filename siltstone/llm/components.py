"""Connected components by alternating large-star and small-star rounds, all of it distributed.

Each round is two aggregations and two joins over the edges; edges are written to the shared folder between
rounds, so lineage stays short and a lost executor costs one round. Nothing but counts goes to the driver.
Rounds grow with the logarithm of the number of nodes, and end as soon as all edges are stars: a round more to see that
nothing moves would cost the driver its plans, stages and broadcasts again.

A node with many edges (a hub) would send all of them to one task. Nodes with at least one in HUBS of all edge ends (so at
most HUBS of them) have their minima broadcast; the others' edges meet theirs in a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import removed, written

HUBS = 2000


def _with_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """edges (u, v) with u's value m of least (u, m, n)."""
    if ends <= HUBS:
        return edges.join(F.broadcast(least.select("u", "m")), "u")
    hub = F.col("n") * HUBS >= F.lit(ends)
    often = F.broadcast(least.where(hub).select(F.col("u").alias("h"), F.col("m").alias("of_hub")))
    parted = edges.join(often, F.col("u") == F.col("h"), "left").drop("h")
    others = parted.where("of_hub is null").drop("of_hub").join(least.where(~hub).select("u", "m"), "u")
    return parted.where("of_hub is not null").withColumnRenamed("of_hub", "m").unionByName(others)


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    out = _with_least(edges, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).distinct()


def _shape(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and of nodes with two smaller neighbours or with a smaller and a larger one. Without such nodes all edges lead to the smallest of their component."""
    ends = edges.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    of = ends.groupBy("u").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    between = (F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))
    return tuple(of.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if(between)).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b; long) -> node, root: the smallest node that each node with an edge reaches. Loops and repeats are ignored. Not done in `rounds`: an error."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for done in range(rounds + 1):
        n, between = _shape(now)
        if not between:
            break
        if done == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        middle = written(_large(now, n), "edges")
        after = written(_small(middle, n), "edges")
        removed(now.sparkSession, middle)
        removed(now.sparkSession, now)
        now = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
