"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import dropped, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` of every node that has an edge; component is its smallest node.

    ``edges`` has two columns of one ordered type in any order and direction; loops, repeats and rows with a
    null end are ignored, an empty table gives an empty one. Each round writes its edges to the
    shared folder, so that lineage stays short; only a count and a sum reach the driver. Every
    step is a minimum per node joined back to the edges, so no node's neighbours are gathered
    and a hub's edges can be split by the join.
    """
    a, b = edges.columns[:2]
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    now = written(start.distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds if mark[0] else 0):
        after = written(_small_star(_large_star(now)), "edges")
        dropped(now)
        now, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
