"""Connected components of an edge table, by alternating stars, without any node's neighbours in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every node of ``edges(a, b)``; component is the smallest id it reaches.

    Each round replaces the edges of every node by edges to its smallest neighbour: first those of
    larger neighbours, then those of smaller ones. The number of rounds grows with the logarithm of
    the longest path. The minimum per node is combined before the shuffle, and a node with very
    many edges meets them in a join that Spark can split, never in a list.
    """
    state = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    mark = _mark(state)
    while mark[0]:
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # larger neighbours move to the smallest one
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct()
        # then the node and its smaller neighbours do
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").selectExpr("b AS a", "m AS b").union(
            low.selectExpr("a", "m AS b"))
        state = cut(small.where("a <> b").distinct())
        now = _mark(state)
        if now == mark:
            break
        mark = now
    return state.selectExpr("a AS id", "b AS component").union(
        state.selectExpr("b AS id", "b AS component").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("double"))).first())
