"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A node with more than one in HUB of all edges, and more than HUB_EDGES, is a hub; there are at most 2 * HUB of them.
HUB, HUB_EDGES = 1000, 10_000


def _star(edges: DataFrame, large: bool, size: int) -> DataFrame:
    """Large star: every larger neighbour of a node moves to the node's least neighbour. Small star: every smaller one, and
    the node itself, does. Hubs' least neighbours, few by definition, are sent to the tasks, so a hub's edges are never
    gathered in one place."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = both.join(least.drop("n"), "u")
    if size > HUB_EDGES:
        hubs = materialize(least.where(F.col("n") > max(HUB_EDGES, size // HUB)).select("u", F.col("m").alias("hub")), "hubs")
        if hubs.count():
            marked = both.join(F.broadcast(hubs), "u", "left")
            joined = marked.where("hub IS NULL").drop("hub").join(least.drop("n"), "u").unionByName(marked.where("hub IS NOT NULL").withColumnRenamed("hub", "m"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of ids in; (id, component) out for every id that has an edge, component being the least id it reaches."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        now = tuple(edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        for large in (True, False):
            stars = materialize(_star(edges, large, now[0]), "edges")
            discard(edges)
            edges = stars
    own = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out = materialize(own, "components")
    discard(edges)
    return out
