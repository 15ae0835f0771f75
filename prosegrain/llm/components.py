"""Connected components of a graph given by its edges, by alternating stars.

Large-star hangs every larger neighbour of a node on the node's least
neighbour, small-star every smaller one; repeated, each component becomes a
star around its least node. Rounds are written to the shared folder. A node
with very many edges is summed within tasks first, and the joins that follow
are ones the planner can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("low"))
    hung = both.where("v > u").join(least, F.col("u") == F.col("of"))
    return hung.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("low"))
    hung = down.join(least, F.col("u") == F.col("of"))
    return hung.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").union(least.select(F.col("of").alias("u"), F.col("low").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v); a component is named by its least node. No edge: no row."""
    now = cut(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = None
    while (state := mark(now)) != before:
        before = state
        if not state[0]:
            break
        now = cut(_small(_large(now)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
