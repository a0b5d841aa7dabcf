"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a partial aggregate (the least neighbour of every node) and an equi-join with it, so a hub
never meets in one task: Spark's skew join splits its rows. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perambula.llm.common import write_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable over the edges (u, v); nodes without an edge are absent.

    Null ends and loops are ignored; repeated and reversed edges count once.
    """
    clean = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, before = write_table(clean, "edges"), None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        state = write_table(_small_star(_large_star(state)), "edges")
    roots = state.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
