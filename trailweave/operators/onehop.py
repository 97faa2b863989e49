"""One-hop lookups with virtual inverse relations, contradictions, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.functions.vocabulary import Vocabulary

EDGES = "src string, relation string, dst string, weight double, ord bigint"


def step(source: Column, relation: Column, target: Column, weight: Column) -> Column:
    return F.struct(source.alias("source"), relation.alias("relation"), target.alias("target"), weight.alias("weight"))


def _once(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key as ``order`` has it, by an aggregate that sums before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, "_r.*")


def direct(queries: DataFrame, edges: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``qid, object_id, score, geodesic, path, ord`` of each query (qid, anchor, relation or null).

    Outgoing edges of the relation (null: any), all of them; then sources of incoming edges with
    its inverse, each once and only if no outgoing result names it. Score 0. ``ord`` gives ties
    their order: outgoing before incoming, then insertion.
    """
    q = queries.select("qid", "anchor", "relation").withColumn("inverse", vocabulary.inverse_column(F.col("relation")))
    e = edges.select("src", F.col("relation").alias("r"), "dst", "weight", "ord")
    out = q.join(e, (q.anchor == e.src) & (q.relation.isNull() | (q.relation == e.r)))
    out = out.select("qid", F.col("dst").alias("object_id"), F.lit(0).alias("side"), F.col("weight").alias("geodesic"), F.array(step(F.col("src"), F.col("r"), F.col("dst"), F.col("weight"))).alias("path"), "ord")
    back = q.where("inverse is not null").join(e, (q.anchor == e.dst) & (q.inverse == e.r))
    back = back.select("qid", F.col("src").alias("object_id"), F.lit(1).alias("side"), F.col("weight").alias("geodesic"), F.array(step(F.col("src"), F.col("r"), F.col("dst"), F.col("weight"))).alias("path"), "ord")
    back = _once(back, ["qid", "object_id"], [F.col("ord")])
    new = back.join(out.select("qid", "object_id").distinct(), ["qid", "object_id"], "left_anti")
    both = out.unionByName(new)
    return both.select("qid", "object_id", F.lit(0.0).alias("score"), "geodesic", "path", F.struct("side", "ord").alias("ord"))


def contradictions(queries: DataFrame, edges: DataFrame, vocabulary: Vocabulary = Vocabulary(), relation: str = "contradicts") -> DataFrame:
    """``qid, object_id, score, path``: the other ends of the relation's edges, both ways if it is symmetric.

    Each other end once, an outgoing edge first; score is the weight; no limit, and no check that
    the anchor exists.
    """
    q = queries.select("qid", "anchor")
    e = edges.where(F.col("relation") == relation)
    path = F.array(step(F.col("src"), F.col("relation"), F.col("dst"), F.col("weight"))).alias("path")
    found = q.join(e, q.anchor == e.src).select("qid", F.col("dst").alias("object_id"), F.lit(0).alias("side"), "ord", "weight", path)
    if vocabulary.properties(relation).symmetric:
        found = found.unionByName(q.join(e, q.anchor == e.dst).select("qid", F.col("src").alias("object_id"), F.lit(1).alias("side"), "ord", "weight", path))
    return _once(found, ["qid", "object_id"], [F.col("side"), F.col("ord")]).select("qid", "object_id", F.col("weight").alias("score"), "path")


def neighbors(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """``src, targets``: targets of an object's own edges in order, repeats kept."""
    own = edges if relation is None else edges.where(F.col("relation") == relation)
    return own.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("targets"))


def ranked(results: DataFrame, order: list[Column], k: int | Column | None = None) -> DataFrame:
    """With ``rank`` within qid; at most ``k`` rows each (a top-k report)."""
    out = results.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)
