"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round rewires each vertex's neighbours to the smallest vertex it knows, by a partially
aggregated minimum and a join; no vertex's neighbour list is ever collected. Each round's
edges are written to the shared checkpoint folder, so a lost executor costs at most a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commune.llm.common import cut


def _min_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    joined = both.join(_min_of(both), "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    joined = down.join(_min_of(down), "u")
    kept = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
        joined.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return kept.where("a < b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is the smallest node reachable.

    Null ends and self-loops are no edges; repeated edges count once; no edges, no rows.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .where("a < b").distinct())
    mark = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        edges = cut(_small_star(_large_star(edges)))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
