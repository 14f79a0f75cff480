"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours go to the smallest of it and its neighbours. Small star: the others do, and the node itself.

    The smallest is found with partial sums and joined back as one row a node, so a node of very many edges is split by the skew join.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.where("v < u")
    least = side.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = (both.where("v > u") if large else side).join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.where("u != m").select("u", F.col("m").alias("v")))
    return moved.distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another node: component is the smallest node reachable.

    Nodes are of any ordered type. Null ends and loops count for nothing. Each round is written to the shared folder; rounds end when
    the edges no longer change, which takes a number logarithmic in the longest path.
    """
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark[0] == 0 or mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
        then = written(_star(_star(now, True), False), "edges")
        discard(now)
        now = then
    raise RuntimeError(f"components not found in {max_rounds} rounds")
