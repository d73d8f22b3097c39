"""Connected components by alternating stars, as joins and grouped minima.

Each turn hangs every node's larger neighbours, then its smaller ones, on the smallest
node seen there (Kiveris and others, 2014). Edges end as stars around the smallest node
of each component. Minima combine before the shuffle and the joins are plain equi-joins,
which AQE splits, so a node with very many edges needs no task of its own. Each turn is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelwright.session import spool


def _turn(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )
    large = spool(large, "large-star")
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u")
    return (
        small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(small.select("u", F.col("m").alias("v"))).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Does every node either have one smaller neighbour and no other, or only larger ones?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not sums.where("up > 1 OR (up > 0 AND down > 0)").head(1)


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, root): every node that has a link, with the smallest of its component."""
    edges = spool(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    while not _stars(edges):
        edges = spool(_turn(edges), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
