"""Stalks, restriction maps, composition residuals, and maps learned by Procrustes."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import shipped
from trailweave.functions.vocabulary import Vocabulary


def seed_of(name: str) -> int:
    """The first 8 bytes of the name's SHA-256, big-endian."""
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")


def default_stalk(name: str, dim: int) -> np.ndarray:
    """A seeded Gaussian vector of length 1 for an object without its own stalk."""
    v = np.random.default_rng(seed_of(name)).standard_normal(dim)
    return v / (np.linalg.norm(v) or 1.0)


def canonical(relation: str, vocabulary: Vocabulary) -> tuple[str, bool, bool]:
    """(name whose map is stored, whether ``relation`` takes its transpose, whether it has one map both ways).

    A relation without a known inverse counts as its own.
    """
    inverse = vocabulary.inverse_of(relation)
    if inverse in (None, relation):
        return relation, False, True
    return min(relation, inverse), inverse < relation, False


def restriction_map(relation: str, dim: int, vocabulary: Vocabulary = Vocabulary(), maps: Mapping[str, np.ndarray] | None = None) -> np.ndarray:
    """The learned map of that size if there is one, else a seeded orthogonal matrix with fixed signs."""
    own = (maps or {}).get(relation)
    if own is not None and np.shape(own) == (dim, dim):
        return np.asarray(own)
    name, transposed, _ = canonical(relation, vocabulary)
    if transposed:
        return restriction_map(name, dim, vocabulary, maps).T
    q, r = np.linalg.qr(np.random.default_rng(seed_of(relation)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def composed(relations: Sequence[str], dim: int, vocabulary: Vocabulary = Vocabulary(), maps=None) -> np.ndarray:
    """The product of the maps along a path, the first one applied first."""
    out = np.eye(dim)
    for r in relations:
        out = restriction_map(r, dim, vocabulary, maps) @ out
    return out


def residual(a: np.ndarray, b: np.ndarray, relations: Sequence[str], vocabulary: Vocabulary = Vocabulary(), maps=None) -> float:
    if not len(relations):
        return 0.0
    return float(np.linalg.norm(composed(relations, len(a), vocabulary, maps) @ a - b) / (np.linalg.norm(b) or 1.0))


def residuals(rows: DataFrame, dim: int = 16, stalks: DataFrame | None = None, vocabulary: Vocabulary | None = None, maps: Mapping[str, np.ndarray] | None = None, name: str = "sheaf") -> DataFrame:
    """``rows`` (anchor, object_id, path) with how far the path's maps miss the object's stalk.

    ``stalks``: id, sheaf_stalk. Ids without one get their default. Matrices of a relation
    sequence are built once in each worker; vectors go through Arrow in batches.
    """
    shipped(rows.sparkSession)
    vocabulary = vocabulary or Vocabulary()
    if stalks is not None:
        s = stalks.select(F.col("id").alias("_id"), F.col("sheaf_stalk").alias("_x"))
        rows = rows.join(s.withColumnsRenamed({"_id": "_a", "_x": "_xa"}), F.col("anchor") == F.col("_a"), "left")
        rows = rows.join(s.withColumnsRenamed({"_id": "_b", "_x": "_xb"}), F.col("object_id") == F.col("_b"), "left").drop("_a", "_b")
    else:
        none = F.lit(None).cast("array<double>")
        rows = rows.withColumns({"_xa": none, "_xb": none})
    rows = rows.withColumn("_relations", F.transform("path", lambda p: p["relation"]))

    @F.pandas_udf("double")
    def missed(anchor: pd.Series, other: pd.Series, xa: pd.Series, xb: pd.Series, relations: pd.Series) -> pd.Series:
        matrices: dict = {}
        known: dict = {}

        def stalk(name, given):
            if given is not None:
                return np.asarray(given)
            if name not in known:
                known[name] = default_stalk(name, dim)
            return known[name]

        out = []
        for a, b, va, vb, r in zip(anchor, other, xa, xb, relations, strict=True):
            x, y, key = stalk(a, va), stalk(b, vb), tuple(r)
            if not key:
                out.append(0.0)
                continue
            if (key, len(x)) not in matrices:
                matrices[key, len(x)] = composed(key, len(x), vocabulary, maps)
            out.append(float(np.linalg.norm(matrices[key, len(x)] @ x - y) / (np.linalg.norm(y) or 1.0)))
        return pd.Series(out)

    return rows.withColumn(name, missed("anchor", "object_id", "_xa", "_xb", "_relations")).drop("_xa", "_xb", "_relations")


def procrustes(moment: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest to a sum of target-source products; the identity for none."""
    if not moment.any():
        return np.eye(len(moment))
    u, _, vt = np.linalg.svd(moment)
    return u @ vt


def moments(edges: DataFrame, stalks: DataFrame) -> DataFrame:
    """``relation, i, j, m``: sums over edges of the target's place i times the source's place j.

    ``edges``: src, relation, dst; ``stalks``: id, sheaf_stalk. Edges without both stalks are left
    out. Products are summed before the shuffle: one matrix for each relation and task leaves it.
    """
    s = stalks.select(F.col("id"), F.col("sheaf_stalk").alias("x"))
    pairs = edges.select("src", "relation", "dst").join(s.withColumnsRenamed({"id": "src", "x": "xa"}), "src").join(s.withColumnsRenamed({"id": "dst", "x": "xb"}), "dst")
    cells = pairs.select("relation", F.posexplode("xb").alias("i", "y"), "xa").select("relation", "i", F.posexplode("xa").alias("j", "x"), "y")
    return cells.groupBy("relation", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("m"))


def learned_maps(edges: DataFrame, stalks: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> dict[str, np.ndarray]:
    """An orthogonal map for each relation that is seen, and the transpose for its inverse, from ``moments``."""
    sums = moments(edges, stalks).toPandas()  # one matrix for each relation
    if not len(sums):
        return {}
    dim = int(sums["i"].max()) + 1
    names = {r: canonical(r, vocabulary) for r in sums["relation"].unique()}
    found: dict[str, np.ndarray] = {}
    for relation, part in sums.groupby("relation"):
        m = np.zeros((dim, dim))
        m[part["i"], part["j"]] = part["m"]
        name, transposed, both = names[relation]
        m = m.T if transposed else m + m.T if both else m
        found[name] = found.get(name, np.zeros((dim, dim))) + m
    out = {}
    for name, m in found.items():
        out[name] = procrustes(m)
        inverse = vocabulary.inverse_of(name)
        if inverse not in (None, name):
            out[inverse] = out[name].T
    return {**{r: np.eye(dim) for r in names}, **out}


def trace(path: Sequence[tuple[str, str, str]], dim: int = 16, vocabulary: Vocabulary = Vocabulary(), maps=None) -> list[dict]:
    """Each step of a path with the vector carried so far and its distance from the step's target."""
    if not path:
        return []
    carried, out = default_stalk(path[0][0], dim), []
    for source, relation, target in path:
        carried = restriction_map(relation, dim, vocabulary, maps) @ carried
        goal = default_stalk(target, dim)
        out.append({"source": source, "relation": relation, "target": target, "carried": carried, "residual": float(np.linalg.norm(carried - goal) / (np.linalg.norm(goal) or 1.0))})
    return out


def text_stalks(texts: DataFrame, dim: int = 32, seed: int = 0) -> DataFrame:
    """``id, sheaf_stalk``: a weighted random projection of each text's tokens, at length 1.

    Weight (1 + ln tf) (ln(N / (1 + df)) + 1); a token's vector is seeded by SHA-256 of the seed
    and the token, once for each distinct token. Texts (id, text) without tokens are left out.
    """
    from trailweave.operators.retrieval import document_frequency, postings

    shipped(texts.sparkSession)
    posted = postings(texts)
    n = texts.agg(F.count(F.lit(1))).scalar()

    @F.pandas_udf("array<double>")
    def projected(term: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(seed_of(f"{seed}:{t}")).standard_normal(dim).tolist() for t in term])

    known = document_frequency(posted).select("term", (F.log(n / (1 + F.col("df"))) + 1).alias("idf"), projected("term").alias("v"))
    weighed = posted.join(known, "term").select("id", ((1 + F.log("tf")) * F.col("idf")).alias("w"), "v")
    sums = weighed.groupBy("id").agg(*[F.sum(F.col("w") * F.get("v", F.lit(k))).alias(f"c{k}") for k in range(dim)])
    raw = F.array(*[F.col(f"c{k}") for k in range(dim)])
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return sums.where(length > 0).select("id", F.transform(raw, lambda x: x / length).alias("sheaf_stalk"))


def stalk_export(objects: DataFrame, edges: DataFrame, dim: int = 3) -> DataFrame:
    """``id, stalk, dangling`` of every node, targets that are no objects included."""
    from trailweave.plans.query import graph_export

    shipped(objects.sparkSession)

    @F.pandas_udf("array<double>")
    def stalk(name: pd.Series) -> pd.Series:
        return pd.Series([default_stalk(x, dim).tolist() for x in name])

    return graph_export(objects, edges).select("id", stalk("id").alias("stalk"), "dangling")
