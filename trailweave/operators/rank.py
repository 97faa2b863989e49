"""Composite ranking of traversal results, and their explanation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.functions.vectors import similarity

#: mode -> (topology term, sheaf term)
MODES = {"graph": (False, False), "topo": (True, False), "sheaf": (False, True), "reasoning": (True, True), "full": (True, True)}


@dataclass(frozen=True)
class Weights:
    geodesic: float = 0.5
    topology: float = 0.3
    sheaf: float = 0.2
    sheaf_dim: int = 16
    bandwidth: float = 1.0


def mode_flags(mode: str) -> tuple[bool, bool]:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    return MODES[mode]


def scored(candidates: DataFrame, mode: str, weights: Weights = Weights(), signatures: DataFrame | None = None, stalks: DataFrame | None = None, vocabulary=None, maps=None) -> DataFrame:
    """``candidates`` (qid, anchor, object_id, geodesic, path, ...) with score and components.

    The topology term is left out where either signature is missing, so such rows rank better,
    all else equal; the sheaf term takes default stalks where none is given.
    """
    use_topology, use_sheaf = mode_flags(mode)
    out, parts = candidates, {"geodesic": F.col("geodesic")}
    score = weights.geodesic * F.col("geodesic")
    if use_topology and signatures is not None:
        s = signatures.select(F.col("id").alias("_id"), F.col("topo_signature").alias("_sig"))
        out = out.join(s.withColumnsRenamed({"_id": "_a", "_sig": "_sa"}), F.col("anchor") == F.col("_a"), "left")
        out = out.join(s.withColumnsRenamed({"_id": "_b", "_sig": "_sb"}), F.col("object_id") == F.col("_b"), "left")
        term = F.when(F.col("_sa").isNotNull() & F.col("_sb").isNotNull(), 1 - similarity(F.col("_sa"), F.col("_sb"), weights.bandwidth))
        out = out.withColumn("topo", term).drop("_a", "_b", "_sa", "_sb")
        score = score + F.coalesce(weights.topology * F.col("topo"), F.lit(0.0))
        parts["topo"] = F.col("topo")
    if use_sheaf:
        from trailweave.operators.sheaf import residuals

        out = residuals(out, weights.sheaf_dim, stalks=stalks, vocabulary=vocabulary, maps=maps)
        score = score + weights.sheaf * F.col("sheaf")
        parts["sheaf"] = F.col("sheaf")
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in parts.items()]), lambda p: p["v"].isNotNull())
    return out.withColumn("score", score).withColumn("components", F.map_from_entries(pairs)).drop("topo", "sheaf")


def explained(path: Column, score: Column, hops: Column) -> Column:
    """``a --[r]--> b --[r]--> c  (score=0.0000, hops=2)``"""
    steps = F.transform(path, lambda s: F.concat(F.lit(" --["), s["relation"], F.lit("]--> "), s["target"]))
    return F.concat(F.get(path, F.lit(0))["source"], F.array_join(steps, ""), F.format_string("  (score=%.4f, hops=%d)", score, hops))
