"""Connected components of a table of links, by contraction.

Each round every node points at its least neighbour, pointers are followed to their ends,
and links are moved to those ends; inner and repeated links go. The number of rounds
follows the logarithm of the longest path. Minima are taken before rows are dealt out, so a node
with very many links costs no more than one with few.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a and b); the component is its least node."""
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not links.isEmpty():
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = stored(ways.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("end")), "ends")
        while True:
            next_ = ends.select(F.col("node").alias("end"), F.col("end").alias("far"))
            jumped = stored(ends.join(next_, "end").select("node", F.col("far").alias("end"), (F.col("far") != F.col("end")).alias("moved")), "ends")
            dropped(ends)
            ends = jumped.select("node", "end")
            if jumped.where("moved").isEmpty():
                break
        moved = (links.join(ends.select(F.col("node").alias("a"), F.col("end").alias("x")), "a")
                 .join(ends.select(F.col("node").alias("b"), F.col("end").alias("y")), "b").where("x <> y")
                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        left = stored(moved, "links")
        dropped(links)
        links = left
        if found is None:
            found = ends.select("node", F.col("end").alias("component"))
        else:
            further = ends.select(F.col("node").alias("component"), F.col("end").alias("_end"))
            longer = stored(found.join(further, "component", "left")
                            .select("node", F.coalesce("_end", "component").alias("component")), "found")
            dropped(found)
            dropped(ends)
            found = longer
    if found is None:
        found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
