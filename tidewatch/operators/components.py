"""Connected components by alternating large-star and small-star rounds.

Follows Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
Every round is a min-aggregation (combined before the shuffle) and a join of the
edges with one row per node, so a hub's edges may be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): the smallest node id of each component names it."""
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e)

    def state(d: DataFrame) -> tuple:
        row = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    seen = state(e)
    while True:
        e = cut_lineage(_small_star(_large_star(e).distinct()).distinct())
        now = state(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.distinct())
