"""Places and running sums in an order, over ranges of rows: no task sees all rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.cluster import written


def running(rows: DataFrame, count: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``upto``, the sum of ``count`` up to and with a row in ``order``, and ``n``, that of all, for each of ``by``.

    Rows of one order in one group should be one. Ranges are written with their numbers, as two
    runs could cut them differently; sums before a range come from one row for each group in it.
    """
    keys = list(by) or ["_all"]
    own = rows if by else rows.withColumn("_all", F.lit(1))
    ranged = written(own.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    w = W.partitionBy(*keys).orderBy("_part")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(count).alias("_sum"))
    before = sums.select(*keys, "_part", (F.sum("_sum").over(w) - F.col("_sum")).alias("_below"), F.sum("_sum").over(W.partitionBy(*keys)).alias("n"))
    inner = F.sum(count).over(W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = ranged.withColumn("_own", inner).join(before, [*keys, "_part"])
    return out.withColumn("upto", F.col("_own") + F.col("_below")).select(*rows.columns, "upto", "n")


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``at``, their place from 1 in ``order``."""
    out = running(rows.withColumn("_one", F.lit(1)), "_one", [], order)
    return out.withColumnRenamed("upto", "at").drop("_one", "n")


def at_ranks(counted: DataFrame, ranks, by: Sequence[str]) -> DataFrame:
    """Rows of ``counted`` (by, v, c) that hold one of ``ranks``, an array column over ``n``, as ``rank`` and ``v``."""
    run = running(counted, "c", by, ["v"]).withColumn("rank", F.explode(ranks))
    return run.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank"))).select(*by, "rank", "v")


def medians(values: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """``by, name``: the median of ``value``, the mean of the two in the middle of an even number."""
    counted = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    middle = F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    return at_ranks(counted, middle, by).groupBy(*by).agg(F.avg("v").alias(name))
