"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_split, settle

C = F.col


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, v) with the smallest of u and its neighbours v; partial minima are taken before the shuffle."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("count"))
    low = low.select(C("u").alias("_u"), F.least("u", "m").alias("m"), "count")
    return join_split(pairs, low, "u", "_u").drop("_u")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(C("v").alias("u"), C("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root being the smallest node that is reachable.

    Each round is written to the shared folder, so plans stay short and survive lost executors. A node with very many
    edges is joined with its minimum where its edges lie. Edges with a null end
    and loops are left out; an empty table has no nodes.
    """
    now = settle(edges.select("u", "v").filter(C("u") != C("v")).distinct(), "edges")
    seen = None
    while True:
        large = _smallest(_both_ways(now)).filter(C("v") > C("u")).select(C("v").alias("u"), C("m").alias("v"))
        large = large.filter(C("u") != C("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _smallest(down)
        small = small.select(C("v").alias("u"), C("m").alias("v")).unionByName(small.select("u", C("m").alias("v")))
        now = settle(small.filter(C("u") != C("v")).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(C("u").alias("node"), "root")
    return roots.unionByName(roots.select(C("root").alias("node"), "root").distinct())
