"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, parts, slim


def connected_components(links: DataFrame, space: Workspace, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) of all linked nodes, root being the smallest node of the component.

    Only links and per-node minima move. Minima come from partial aggregates, and the table of minima is dealt anew
    before each join, so that a node with very many links can be split among tasks. Each round is written to the
    shared folder; the rounds end when the links are stars. Self-links, nulls and repeated links are ignored.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    edges = space.put(slim(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u > v").distinct()), f"{name}-0")
    k = 0
    while not _stars(edges):
        k += 1
        # Large star: each larger neighbour links to the smallest of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")).repartition(parts(edges))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: each smaller neighbour, and the node itself, links to the smallest neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m").repartition(parts(edges))
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = space.put(slim(small.where("u != v").distinct()), f"{name}-{k}")
        space.drop(f"{name}-{k - 1}")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one link to a root that has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("n")).first().n == 0
