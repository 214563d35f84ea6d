"""Connected components of a link table, by alternating large-star and small-star steps.

Each step sends every node to the smallest label it sees, in joins and minima
that combine before the shuffle, so no group is collected in one place and
nothing but two counts reaches the driver. Steps are written to the shared
folder: both sides of each join are plain tables, whose skewed partitions
adaptive execution can split, and a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialised


def _step(edges: DataFrame, name: str, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large star: larger neighbours go to the least one. Small star: smaller ones do. The files of edges go."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialised(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    met = seen.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    out = materialised(out.filter("u > v").distinct(), name)
    for done in (least, edges):
        drop_table(edges.sparkSession, done)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (u long, v long): root is the least node that it reaches. Nodes that are their own root are left out."""
    edges = materialised(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, k = state(edges), 0
    while before[0]:
        edges = _step(_step(edges, f"large-{k}", True), f"small-{k}", False)
        now, k = state(edges), k + 1
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
