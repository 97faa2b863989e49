"""Neighbourhood shapes: persistent homology of ego nets, and nearest neighbours by signature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.cluster import shipped, written
from trailweave.functions.vectors import planes, probe_codes, sign_code, sign_planes, similarity, unit

BINS, HOPS = 32, 2


def distances(n: int, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """All shortest distances of an undirected graph on 0..n-1; unreachable: n + 1."""
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0.0)
    for a, b, w in edges:
        if a != b:
            d[a, b] = d[b, a] = min(d[a, b], w)
    # No shortest way leads through a node with a single neighbour.
    for k in np.flatnonzero(np.isfinite(d).sum(axis=1) > 2):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    d[np.isinf(d)] = n + 1.0
    return d


def deaths_of_components(d: np.ndarray) -> list[float]:
    """Finite H0 deaths: the edges of a least spanning tree; components at distance 0 have no bar."""
    near, left, out = d[0].copy(), np.ones(len(d), bool), []
    left[0] = False
    for _ in range(len(d) - 1):
        k = int(np.where(left, near, np.inf).argmin())
        out.append(float(near[k]))
        left[k] = False
        near = np.minimum(near, d[k])
    return [x for x in out if x > 0]


def loops(d: np.ndarray) -> list[tuple[float, float]]:
    """H1 bars (birth, death) of the Vietoris-Rips complex.

    At the enclosing radius, the least distance within which one point sees all, the complex is a
    cone: loops that still live die there, and no pair that far apart bears one. So only shorter
    pairs count, few in a net of steps. Of these, those that join no components bear a loop each;
    their triangles go by diameter, each a set of edges with the latest as pivot. Adding the
    earlier triangle with the same pivot until the pivot is new pairs that edge with the diameter.
    """
    n = len(d)
    radius = d.max(axis=1).min()
    i, j = np.nonzero(np.triu(d < radius, 1))
    order = np.lexsort((j, i, d[i, j]))
    edges = list(zip(i[order].tolist(), j[order].tolist(), strict=True))
    place, ahead = {e: k for k, e in enumerate(edges)}, [set() for _ in range(n)]
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    alive, triangles = [], []
    for k, (a, b) in enumerate(edges):
        if top(a) == top(b):
            alive.append(k)
            triangles += [(k, (k, place[min(a, c), max(a, c)], place[min(b, c), max(b, c)])) for c in sorted(ahead[a] & ahead[b])]
        root[top(a)] = top(b)
        ahead[a].add(b)
        ahead[b].add(a)
    reduced: dict[int, set[int]] = {}
    dies = dict.fromkeys(alive, float(radius))
    for last, sides in triangles:
        column = set(sides)
        while column and (pivot := max(column)) in reduced:
            column ^= reduced[pivot]
        if column:
            reduced[pivot] = column
            dies[pivot] = float(d[edges[last]])
    return [(float(d[edges[k]]), death) for k, death in dies.items() if death > d[edges[k]]]


def signature(d: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Histograms of H0 and H1 lifetimes over (0, largest finite death); zeros for under 2 points.

    The bar that never dies lies beyond the range and so has no bin.
    """
    if len(d) < 2:
        return np.zeros(2 * bins)
    zero, one = deaths_of_components(d), loops(d)
    top = max([*zero, *(x for _, x in one)], default=1.0) or 1.0
    lives = (zero, [b - a for a, b in one])
    return np.concatenate([np.histogram(x, bins=bins, range=(0.0, top))[0].astype(float) if x else np.zeros(bins) for x in lives])


def ego_nets(objects: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """``id, node``: nodes within ``hops`` undirected steps of each object, dangling ones too."""
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    seen = objects.select("id", F.col("id").alias("node")).distinct()
    for _ in range(hops):
        seen = seen.unionByName(seen.join(both, seen.node == both.a).select("id", F.col("b").alias("node"))).distinct()
    return seen


def _triangles(pairs: DataFrame) -> DataFrame:
    """``id, a, b, w``: for each triangle of ``pairs`` (a, b, w) and each of its corners the edge across.

    Every edge goes from its end with fewer neighbours, so a hub's edges don't meet each other.
    """
    ends = pairs.select(F.col("a").alias("u")).unionByName(pairs.select(F.col("b").alias("u"))).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(ends.toDF("a", "_na"), "a").join(ends.toDF("b", "_nb"), "b")
    lo, hi = F.struct(F.col("_na").alias("n"), F.col("a").alias("u")), F.struct(F.col("_nb").alias("n"), F.col("b").alias("u"))
    ahead = both.select(F.least(lo, hi)["u"].alias("u"), F.greatest(lo, hi)["u"].alias("v"), "w")
    wedges = ahead.toDF("u", "x", "wx").join(ahead.toDF("u", "y", "wy"), "u").where("x < y")
    met = wedges.join(pairs.toDF("x", "y", "w"), ["x", "y"])
    corner = lambda i, a, b, w: F.struct(F.col(i).alias("id"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(w).alias("w"))
    return met.select(F.inline(F.array(corner("u", "x", "y", "w"), corner("x", "u", "y", "wy"), corner("y", "u", "x", "wx"))))


def _star_signatures(star: DataFrame, bins: int) -> DataFrame:
    """``id, topo_signature, n_nodes`` of nets without a triangle, whose edges are ``star`` (id, o, w): their weights are the deaths, and no loop lives."""
    tops = star.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("w") > 0, F.col("w"))), F.lit(1.0)).alias("top"))
    w, top = F.col("w"), F.col("top")
    # As numpy's histogram: a place by division, then set right against the bins' edges.
    at = F.least(F.floor(w / top * bins), F.lit(bins - 1))
    rows = star.join(tops, "id").withColumn("_at", at).withColumn("_at", F.col("_at") - (w < F.col("_at") * (top / bins)).cast("int"))
    rows = rows.withColumn("_at", F.col("_at") + ((w >= (F.col("_at") + 1) * (top / bins)) & (F.col("_at") < bins - 1)).cast("int"))
    counts = [F.sum(((F.col("_at") == k) & (w > 0)).cast("double")) for k in range(bins)]
    return rows.groupBy("id").agg(F.array(*counts, *[F.lit(0.0)] * bins).alias("topo_signature"), (F.count(F.lit(1)) + 1).alias("n_nodes"))


def signatures(objects: DataFrame, edges: DataFrame, hops: int = HOPS, bins: int = BINS) -> DataFrame:
    """``id, topo_signature, n_nodes`` of every object with a neighbour.

    At one step nets without a triangle are stars and take aggregates only. Edges inside each
    other net are gathered per object, so memory is for one net, with the square of its nodes: two steps around a
    hub are its neighbours' neighbours.
    """
    shipped(objects.sparkSession)
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").where("a <> b").groupBy("a", "b").agg(F.min("weight").alias("w"))
    stars = None
    if hops == 1:
        pairs = written(pairs, "pairs")
        ids = objects.select("id").distinct()
        star = pairs.select(F.col("a").alias("id"), F.col("b").alias("o"), "w").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("o"), "w")).join(ids, "id", "left_semi")
        across = written(_triangles(pairs).join(ids, "id", "left_semi"), "triangles")
        # A negative weight lets a way back and forth be short, which a star doesn't show.
        other = across.select("id").unionByName(star.where("w < 0 or w is null").select("id")).distinct()
        stars = _star_signatures(star.join(other, "id", "left_anti"), bins)
        inside = star.join(other, "id", "left_semi").select("id", F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"), "w").unionByName(across)
    else:
        nets = ego_nets(objects, edges, hops)
        inside = nets.join(pairs, nets.node == pairs.a).select("id", "a", "b", "w")
        inside = inside.join(nets.select("id", F.col("node").alias("b")), ["id", "b"]).select("id", "a", "b", "w")

    def signed(group: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*group["a"], *group["b"]})
        at = {x: k for k, x in enumerate(nodes)}
        d = distances(len(nodes), [(at[a], at[b], w) for a, b, w in zip(group["a"], group["b"], group["w"], strict=True)])
        return pd.DataFrame({"id": [group["id"].iloc[0]], "topo_signature": [signature(d, bins)], "n_nodes": [len(nodes)]})

    rest = inside.groupBy("id").applyInPandas(signed, "id string, topo_signature array<double>, n_nodes long")
    return rest if stars is None else stars.unionByName(rest)


def affected(changed: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """``id`` of objects whose ego net holds a changed one: what a change makes stale."""
    return ego_nets(changed.select("id"), edges, hops).select(F.col("node").alias("id")).distinct()


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("qid").orderBy(F.col("similarity").desc(), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, columns: list[str], size: int):
    """Rows of ``queries`` in blocks of ``size``, one after the other through the driver."""
    block = []
    for row in queries.select(*columns).toLocalIterator(prefetchPartitions=False):
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def exact_top(queries: DataFrame, entries: DataFrame, k: int = 5, bandwidth: float = 1.0, block: int = 50_000, planes: int = 0, radius: int = 0, seed: int = 0) -> DataFrame:
    """``qid, id, similarity, rank``: the ``k`` most similar entries, over all of them.

    Queries (qid, vector) are a stated set, broadcast in blocks of ``block``; every entry (id,
    vector) is held against them in batches by an Arrow function that keeps the best of each
    batch, so pairs are never rows. Similarity is rounded to 9 digits, ties go by id. With
    ``planes`` (a multiple of 8), see ``sketch_top``.
    """
    spark = queries.sparkSession
    shipped(spark)
    entry, query = entries.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()

    def against(block: list) -> DataFrame:
        ids = np.array([r["qid"] for r in block], object)
        v = np.array([r["vector"] for r in block], float).reshape(len(block), -1)
        n = np.linalg.norm(v, axis=1)
        units = v / np.where(n > 0, n, 1)[:, None]
        signs = np.array(sign_planes(planes, v.shape[1], seed), float) if planes else None
        codes = lambda x: np.packbits(x @ signs.T >= 0, axis=1).view(np.uint8)
        held = spark.sparkContext.broadcast((ids, units, codes(units) if planes else None))

        def search(batches):
            names, units, own = held.value
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.array([np.asarray(r, float) for r in pdf["vector"]])
                n = np.linalg.norm(x, axis=1)
                x = x / np.where(n > 0, n, 1)[:, None]
                theirs = codes(x) if planes else None
                parts = []
                for at in range(0, len(names), 256):
                    u = units[at : at + 256]
                    zero_u, zero_x = ~u.any(axis=1), ~x.any(axis=1)
                    if planes:
                        apart = np.zeros((len(u), len(x)), np.int32)
                        for byte in range(theirs.shape[1]):
                            apart += np.bitwise_count(own[at : at + 256, byte, None] ^ theirs[None, :, byte])
                        i, j = np.nonzero(apart <= radius)
                        s = None
                    else:
                        d = np.sqrt(np.maximum(0.0, (u * u).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * u @ x.T))
                        s = np.where(zero_u[:, None] & zero_x[None, :], 1.0, np.where(zero_u[:, None] | zero_x[None, :], 0.0, np.exp(-bandwidth * d)))
                        some = min(k, s.shape[1])
                        floor = np.partition(s, s.shape[1] - some, axis=1)[:, s.shape[1] - some]
                        i, j = np.nonzero(s >= floor[:, None] - 1e-7)
                    exact = np.exp(-bandwidth * np.sqrt(((u[i] - x[j]) ** 2).sum(1)))
                    exact = np.where(zero_u[i] & zero_x[j], 1.0, np.where(zero_u[i] | zero_x[j], 0.0, exact))
                    own_part = pd.DataFrame({"qid": names[at : at + 256][i], "id": pdf["id"].to_numpy()[j], "similarity": np.round(exact, 9)})
                    if planes:
                        own_part["ranked"] = own_part.groupby("qid")["id"].transform("size")
                        own_part = own_part.sort_values(["qid", "similarity", "id"], ascending=[True, False, True]).groupby("qid").head(k)
                        first = ~own_part.duplicated("qid")
                        own_part["ranked"] = own_part["ranked"].where(first, 0)
                    parts.append(own_part)
                yield pd.concat(parts)

        more = ", ranked bigint" if planes else ""
        return entries.where("vector is not null").select("id", "vector").mapInPandas(search, f"qid {query}, id {entry}, similarity double{more}")

    found = None
    for rows in _blocks(queries.where("vector is not null"), ["qid", "vector"], block):
        part = against(rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"qid {query}, id {entry}, similarity double{', ranked bigint' if planes else ''}")
    return _best(found, k) if not planes else _counted(found, k)


def _counted(found: DataFrame, k: int) -> DataFrame:
    whole = W.partitionBy("qid")
    return _best(found.withColumn("ranked", F.sum("ranked").over(whole)), k)


def sketch_top(queries: DataFrame, entries: DataFrame, k: int = 5, planes: int = 256, radius: int = 112, seed: int = 0, bandwidth: float = 1.0) -> DataFrame:
    """``qid, id, similarity, rank, ranked``: as ``exact_top``, but only entries are ranked whose sketch is near.

    A sketch has the signs of ``planes`` seeded planes; entries within ``radius`` differing bits of a query are ranked exactly, so their number
    (``ranked``) is a small share of all where buckets of few bits would miss distant neighbours.
    All entries are looked at, in batches, at a bit for each plane; ``recall`` measures the misses.
    """
    return exact_top(queries, entries, k, bandwidth, planes=planes, radius=radius, seed=seed)


def index(entries: DataFrame, dim: int, n_planes: int = 16, seed: int = 0, tables: int = 1) -> DataFrame:
    """``id, vector, codes``: every entry at length 1 with its sign code in each of ``tables`` sets of planes."""
    bad = F.raise_error(F.concat(F.lit("vector length "), F.size("vector").cast("string"), F.lit(f"; the index has {dim}")))
    own = entries.where("vector is not null").select("id", F.when(F.size("vector") != dim, F.array(bad.cast("double"))).otherwise(unit(F.col("vector"))).alias("vector"))
    return own.withColumn("codes", F.array(*[sign_code(F.col("vector"), planes(n_planes, dim, seed + t)) for t in range(tables)]))


def near_top(queries: DataFrame, indexed: DataFrame, dim: int, k: int = 5, radius: int = 2, n_planes: int = 16, seed: int = 0, bandwidth: float = 1.0, tables: int = 1) -> DataFrame:
    """``qid, id, similarity, rank``: entries of the buckets within ``radius`` flipped bits in any table, exactly ranked.

    An equi-join on table and bucket code. For close neighbours; ``sketch_top`` finds distant ones.
    Entries are all indexed; ``recall`` measures what the probes miss.
    """
    q = queries.where("vector is not null").select("qid", unit(F.col("vector")).alias("u"))

    def probes(t: int):
        codes = probe_codes(sign_code(F.col("u"), planes(n_planes, dim, seed + t)), n_planes, radius)
        return F.transform(codes, lambda c: F.struct(F.lit(t).alias("t"), c.alias("code")))

    own = F.array(*map(probes, range(tables)))
    q = q.select("qid", "u", F.inline(F.flatten(own)))
    met = q.join(indexed.select("id", "vector", F.posexplode("codes").alias("t", "code")), ["t", "code"])
    pairs = met.groupBy("qid", "id").agg(F.first("u").alias("u"), F.first("vector").alias("vector"))
    return _best(pairs.select("qid", "id", F.round(similarity(F.col("u"), F.col("vector"), bandwidth), 9).alias("similarity")), k)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """``n, found, recall``: which share of the exact top lists the approximate ones hold."""
    hit = exact.select("qid", "id").join(approximate.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).select("n", "found", (F.col("found") / F.nullif(F.col("n"), F.lit(0))).alias("recall"))
