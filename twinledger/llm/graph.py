"""Connected components of a graph given as an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (columns ``a``, ``b``).

    Each round links all neighbours of a node to the smallest of them, first the larger ones, then the
    smaller ones; it ends when every node hangs on its smallest. The number of rounds grows with the
    logarithm of the number of nodes. Rounds are written to the shared folder. Smallest neighbours are
    written too, so that the joins with them can be split where a node has very many links.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = scratch.write(links)
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.write(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lower = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(links, least, large, lower)
        links, before = new, state
        state = _state(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
