"""Batch queries: text or structure in, ranked results with their paths out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import written
from trailweave.functions.vocabulary import Vocabulary
from trailweave.operators import topology
from trailweave.operators.extraction import parse_intents
from trailweave.operators.onehop import direct, ranked
from trailweave.operators.rank import Weights, explained, mode_flags, scored
from trailweave.operators.traversal import geodesic_paths

_OPTIONAL = {"text": "string", "anchor": "string", "relation": "string", "chain": "array<string>", "target": "string", "k": "int", "max_hops": "int"}


def clamped(queries: DataFrame, most_k: int = 100, most_hops: int = 8) -> DataFrame:
    """``queries`` with k (5 where it is missing) from 1 to ``most_k`` and hops, where given, from 1 to ``most_hops``: a server's limits."""
    for name in ("k", "max_hops"):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast("int"))
    within = lambda c, most: F.greatest(F.lit(1), F.least(c, F.lit(most)))
    hops = F.when(F.col("max_hops").isNotNull(), within(F.col("max_hops"), most_hops))
    return queries.withColumns({"k": within(F.coalesce("k", F.lit(5)), most_k), "max_hops": hops})


def query(
    queries: DataFrame, objects: DataFrame, edges: DataFrame, mode: str = "full", k: int = 5, vocabulary: Vocabulary = Vocabulary(),
    weights: Weights = Weights(), signatures: DataFrame | None = None, stalks: DataFrame | None = None, maps=None, plan: str = "auto",
) -> DataFrame:
    """``qid, rank, object_id, content, score, geodesic, hops, path, components, explain``.

    ``queries``: qid and any of text, anchor, relation, chain, target, k, max_hops. Text without
    an anchor is parsed against all object ids; its relation counts only without a target. A bare
    relation is a one-hop lookup and isn't ranked further; a chain or target goes by traversal and
    composite ranking, and leaves the relation aside. A mode with the topology term computes the
    signatures of all objects where none are given. Unknown anchors return nothing. Content is
    joined after the top k.
    """
    if mode_flags(mode)[0] and signatures is None:
        signatures = topology.signatures(objects, edges)
    given = {name: name in queries.columns for name in _OPTIONAL}
    for name, kind in _OPTIONAL.items():
        if not given[name]:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    asked = queries.where("anchor is null and text is not null")
    any_text = given["text"] and not asked.isEmpty()
    parsed = (parse_intents if any_text else _none_parsed)(asked.select("qid", "text", "k", "max_hops", F.col("chain").alias("_chain"), F.col("target").alias("_t"), F.col("relation").alias("_r")), objects, vocabulary)
    target = F.coalesce("_t", "target")
    parsed = parsed.select("qid", "anchor", F.coalesce("_r", F.when(target.isNull(), F.col("relation"))).alias("relation"), F.col("_chain").alias("chain"), target.alias("target"), "k", "max_hops")
    edges = edges if hasattr(edges, "_trailweave_path") else written(edges.select([c for c in ("src", "relation", "dst", "weight", "ord") if c in edges.columns]), "edges")
    own = queries.where("anchor is not null").select("qid", "anchor", "relation", "chain", "target", "k", "max_hops").unionByName(parsed)
    own = written(own.withColumn("k", F.coalesce("k", F.lit(k))).join(objects.select(F.col("id").alias("anchor")), "anchor", "left_semi"), "asked")
    bare = F.col("relation").isNotNull() & F.col("chain").isNull() & F.col("target").isNull()
    found = []
    if not own.where(bare).isEmpty():
        near = direct(own.where(bare), edges, vocabulary).join(own.select("qid", "k"), "qid")
        near = ranked(near, [F.col("geodesic"), F.col("ord")], F.col("k"))
        found.append(near.select("qid", "rank", "object_id", "score", "geodesic", F.lit(1).alias("hops"), "path", F.create_map(F.lit("geodesic"), F.col("geodesic")).alias("components")))
    if not found or not own.where(~bare).isEmpty():
        far = geodesic_paths(own.where(~bare), edges, plan=plan).join(own.select("qid", "anchor", "k"), "qid")
        far = scored(far, mode, weights, signatures, stalks, vocabulary, maps)
        found.append(ranked(far, [F.col("score"), F.col("geodesic"), F.col("object_id")], F.col("k")).select("qid", "rank", "object_id", "score", "geodesic", "hops", "path", "components"))
    out = (found[0].unionByName(found[1]) if len(found) > 1 else found[0]).join(objects.select(F.col("id").alias("object_id"), "content"), "object_id", "left")
    return out.select("qid", "rank", "object_id", F.coalesce("content", F.lit("")).alias("content"), "score", "geodesic", "hops", "path", "components", explained(F.col("path"), F.col("score"), F.col("hops")).alias("explain"))


def _none_parsed(asked: DataFrame, ids: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    none = F.lit(None).cast("string")
    return asked.select("*", none.alias("anchor"), none.alias("relation"), none.alias("target")).where("false")


def blast_radius(sources: DataFrame, target: str, edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """``id, hops``: which of ``sources`` (id) reach the target, by one traversal of the edges turned round."""
    spark = edges.sparkSession
    turned = edges.select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst"), F.lit(1.0).alias("weight"), "ord")
    one = spark.createDataFrame([("t", target, max_hops)], "qid string, anchor string, max_hops int")
    return geodesic_paths(one, turned, plan="level", paths=False).join(sources.select(F.col("id").alias("object_id")), "object_id", "left_semi").select(F.col("object_id").alias("id"), "hops")


def graph_export(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, content, dangling``: all nodes, targets that are no objects included."""
    missing = edges.select(F.col("dst").alias("id")).distinct().join(objects.select("id"), "id", "left_anti")
    return objects.select("id", "content", F.lit(False).alias("dangling")).unionByName(missing.select("id", F.col("id").alias("content"), F.lit(True).alias("dangling")))


def results_json(results: DataFrame) -> DataFrame:
    """``qid, json``: each question's results as one JSON array in order of rank."""
    columns = [c for c in ("rank", "object_id", "content", "score", "hops", "explain", "components", "path") if c in results.columns]
    return results.groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)), lambda a, b: a["rank"] - b["rank"])).alias("json"))
