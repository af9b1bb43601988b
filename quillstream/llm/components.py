"""Connected components of a graph of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.staging import drop, stage


def _stars(edges: DataFrame) -> bool:
    """Every node hangs on one node at most, and nothing hangs on one that hangs itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return each.where("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(v, component) for each node of ``links`` (u, v) that isn't the smallest of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each is a minimum per node, which combines before
    the shuffle, and a join, written once; the number of steps grows with the logarithm of the component size, and they end
    when the edges are stars. ``component`` is the smallest node reachable. No links give no rows.
    """
    edges = stage(links.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "links")
    while not _stars(edges):
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        old, edges = edges, stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        drop(old)
        # small star: the smaller neighbours of u, and u, move to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").selectExpr("v as u", "m as v").where("u <> v")
        old, edges = edges, stage(moved.union(least.selectExpr("u", "m as v")).distinct(), "small-star")
        drop(old)
    out = edges.select(F.col("u").alias("v"), F.col("v").alias("component"))
    out._staged_at = edges._staged_at  # for drop()
    return out


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (v, component) after ``links`` (u, v) between any nodes are added, written; only links between different
    components count, so no link that is known is looked at again."""
    of = lambda side, name: labels.select(F.col("v").alias(f"_{name}"), F.col("component").alias(name))
    named = links.join(of("u", "cu"), F.col("u") == F.col("_cu"), "left").join(of("v", "cv"), F.col("v") == F.col("_cv"), "left")
    top = connected_components(named.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    moved = labels.join(top.select(F.col("v").alias("_v"), F.col("component").alias("_to")), F.col("component") == F.col("_v"), "left")
    out = stage(moved.select("v", F.coalesce("_to", "component").alias("component")).unionByName(top), "components")
    drop(top)
    return out
