"""Connected components of a table of links: union-find as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.session import durable


def _contract(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node below the smallest of them: the larger ones (large) or the smaller ones."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    # A node with very many neighbours is split by the adaptive skew join.
    hung = both.join(least, "u").where("v > u" if large else "v < u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        hung = hung.union(least.select("u", F.col("m").alias("v")))
    return durable(hung.where("u <> v").distinct())


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one root at most, and no root hangs below another."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("hangs")).union(edges.select("v", F.lit(0)).distinct())
    return ends.groupBy("id").agg(F.sum("hangs").alias("up"), F.count("*").alias("n")).where("up > 1 OR up = 1 AND n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)``, undirected, to ``(id, component)``: the smallest id reachable, for every id with a link.

    Null ends and links to itself are left out.  Each round is aggregates and joins over
    the links and is kept in the checkpoint folder; nothing but the end of the rounds
    comes to the driver.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = durable(edges)
    while not _is_forest_of_stars(edges):
        edges = _contract(_contract(edges, True), False)
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
