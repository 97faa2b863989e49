"""Hop-bounded traversal of weighted, typed edges for many anchors at once."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import dropped, released, shipped, written
from trailweave.operators.onehop import step

MAX_HOPS = 4
_STEPS = "array<struct<source:string,relation:string,target:string,weight:double>>"
_QUERY = {"chain": "array<string>", "target": "string", "max_hops": "int"}


def prepared(queries: DataFrame) -> DataFrame:
    """``qid, anchor, chain, target, max_hops`` with what is missing as null; 0 or null hops: 4."""
    for name, kind in _QUERY.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    hops = F.when(F.coalesce("max_hops", F.lit(0)) == 0, MAX_HOPS).otherwise(F.col("max_hops"))
    return queries.where("anchor is not null").select("qid", "anchor", "chain", "target", hops.alias("max_hops"))


def checked(edges: DataFrame) -> tuple[float | None, float | None]:
    """Least and largest weight; negative ones are refused, as settling once would be wrong with them."""
    low, high = edges.agg(F.min("weight"), F.max("weight")).first()
    if low is not None and low < 0:
        raise ValueError(f"an edge has weight {low}; weights must not be negative")
    return low, high


def _allowed(chain, hop, relation):
    """Hop ``hop`` must match the chain's entry there; beyond the chain any relation may follow."""
    return F.coalesce(F.get(chain, hop) == relation, F.lit(True))


def _level_by_level(queries: DataFrame, edges: DataFrame, paths: bool) -> DataFrame:
    """All weights equal and positive: a node settles at its least hop, from the least predecessor.

    One join for each hop, of the frontier with the edges; what is settled leaves by an anti join.
    Each level is written, so the next plan starts from a table and the shuffle files
    behind it go; without paths the last one is left to what reads it. A query whose target is settled leaves
    the frontier.
    """
    q = prepared(queries)
    most = q.agg(F.max("max_hops")).first()[0] or 0
    empty = F.array().cast(_STEPS)
    level = q.select("qid", F.col("anchor").alias("node"), F.lit(0.0).alias("cost"), empty.alias("path"))
    e = edges.select("src", "relation", "dst", "weight", "ord")
    done: list[DataFrame] = []
    seen = q.select("qid", F.col("anchor").alias("node"))
    alive = q
    for hop in range(most):
        f = level.join(alive.select("qid", "chain", "max_hops"), "qid").where(F.col("max_hops") > hop)
        reach = f.join(e, f.node == e.src).where(_allowed(F.col("chain"), F.lit(hop), F.col("relation")))
        if paths:
            best = reach.groupBy("qid", F.col("dst").alias("node")).agg(F.min(F.struct("src", "ord", "relation", "weight", "cost", "path")).alias("p"))
            own = step(F.col("p.src"), F.col("p.relation"), F.col("node"), F.col("p.weight"))
            best = best.select("qid", "node", (F.col("p.cost") + F.col("p.weight")).alias("cost"), F.concat(F.col("p.path"), F.array(own)).alias("path"))
        else:
            # A level's costs are all the same, so its nodes are all there is to tell.
            best = reach.select("qid", F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost")).distinct().withColumn("path", empty)
        fresh = best.join(seen, ["qid", "node"], "left_anti").select("qid", "node", "cost", "path")
        if not paths and hop + 1 == most:
            done.append(fresh.withColumn("hops", F.lit(most)))
            break
        level = written(fresh, f"level{hop}")
        del f, reach, best, fresh
        released(q.sparkSession)
        if level.isEmpty():
            break
        done.append(level.withColumn("hops", F.lit(hop + 1)))
        seen = seen.unionByName(level.select("qid", "node"))
        found = level.join(q.where("target is not null").select("qid", F.col("target").alias("node")), ["qid", "node"]).select("qid")
        alive = alive.join(found, "qid", "left_anti")
    out = done[0] if done else level.withColumn("hops", F.lit(0)).where("false")
    for d in done[1:]:
        out = out.unionByName(d)
    return _to_target(out, q)


#: At most so many edges are broadcast; so many ways are in a slice of a level; so many of one query's ways are in an array.
SMALL, WAYS, ARRAY = 1 << 18, 1 << 26, 1 << 20


def _meet(nodes: DataFrame, others: DataFrame) -> bool:
    """Whether two tables of ``node`` have one in common."""
    nodes = nodes.distinct()
    return not others.join(F.broadcast(nodes) if nodes.count() <= SMALL else nodes, "node", "left_semi").isEmpty()


def _level_in_arrays(q: DataFrame, edges: DataFrame, chain: list[str], most: int, weight: float) -> DataFrame:
    """``_level_by_level`` without paths or targets, for queries of one chain and hop limit.

    A level holds a query's nodes in arrays, and a hop moves all targets of a node as one list: a
    row for each node of the frontier, not for each way. A hop of more than ``WAYS`` ways takes its
    queries in slices, each written and its shuffle files released before the next, so the disk holds
    one slice's. Queries with many ways have several arrays, by hash of the node. Only what the
    chain allows is read of the edges; few edges are broadcast; what is settled is taken off where
    targets of this hop can have been reached before.
    """
    level = q.select("qid", F.array("anchor").alias("nodes"))
    levels, met, cost, out = [level], q.select(F.col("anchor").alias("node")), 0.0, None
    one = lambda nodes: F.flatten(F.collect_list(nodes))  # noqa: E731  of arrays, which keep null targets
    for hop in range(most):
        allowed = edges.where(F.col("relation") == chain[hop]) if hop < len(chain) and chain[hop] is not None else edges
        e = allowed.where("src is not null").select("src", "dst")
        targets = e.select(F.col("dst").alias("node"))
        again, met, few = _meet(targets, met), met.unionByName(targets), e.count() <= SMALL
        widest = level.groupBy("qid").agg(F.sum(F.size("nodes")).alias("n")).agg(F.max("n")).first()[0] or 0
        degree = e.groupBy("src").count().agg(F.max("count")).first()[0] or 0
        bins, slices, lists = 1 + widest * degree // ARRAY, 1, None
        binned = (F.pmod(F.xxhash64("dst"), F.lit(bins)) if bins > 1 else F.lit(0)).cast("long").alias("bin")
        if not few:
            lists = written(e.groupBy("src", binned).agg(F.array_distinct(one(F.array("dst"))).alias("nodes")), "lists")
            ways = level.select(F.explode("nodes").alias("src")).join(lists.select("src", F.size("nodes").alias("n")), "src").agg(F.sum("n")).first()[0] or 0
            slices += ways // WAYS

        def fresh(of):
            rows = of(level).select("qid", F.explode("nodes").alias("node"))
            if few:
                new = rows.join(F.broadcast(e.distinct()), F.col("node") == F.col("src")).select("qid", "dst").distinct().select("qid", binned, F.array("dst").alias("nodes"))
            else:
                new = rows.join(lists, F.col("node") == F.col("src")).select("qid", "bin", "nodes")
            if not again:
                return new.groupBy("qid", "bin").agg(F.array_distinct(one("nodes")).alias("nodes")).select("qid", "nodes")
            new = new.withColumn("old", F.lit(False))
            for d in levels:
                own = of(d).select("qid", F.lit(0).cast("long").alias("bin"), "nodes")
                if bins > 1:
                    own = of(d).select("qid", F.explode("nodes").alias("dst")).select("qid", binned, F.array("dst").alias("nodes"))
                new = new.unionByName(own.withColumn("old", F.lit(True)))
            both = new.groupBy("qid", "bin").agg(one(F.when(~F.col("old"), F.col("nodes"))).alias("nodes"), one(F.when(F.col("old"), F.col("nodes"))).alias("old"))
            return both.select("qid", F.array_except("nodes", "old").alias("nodes")).where(F.size("nodes") > 0)

        cost += weight
        if hop + 1 == most and slices == 1:
            level = fresh(lambda df: df)
        else:
            parts = []
            for k in range(slices):
                parts.append(written(fresh(lambda df: df.where(F.pmod(F.xxhash64("qid"), F.lit(slices)) == k) if slices > 1 else df), f"level{hop}"))  # noqa: B023
                released(q.sparkSession)
            level = reduce(DataFrame.unionByName, parts)
            if lists is not None:
                dropped(lists)
            if level.isEmpty():
                break
        levels.append(level)
        rows = level.select("qid", F.explode("nodes").alias("object_id"), F.lit(cost).alias("geodesic"), F.lit(hop + 1).alias("hops"), F.array().cast(_STEPS).alias("path"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else level.select("qid", F.lit("").alias("object_id"), F.lit(cost).alias("geodesic"), F.lit(0).alias("hops"), F.array().cast(_STEPS).alias("path")).where("false")


def _to_target(found: DataFrame, q: DataFrame) -> DataFrame:
    wanted = found.join(q.select("qid", "target"), "qid").where(F.col("target").isNull() | (F.col("target") == F.col("node")))
    return wanted.select("qid", F.col("node").alias("object_id"), F.col("cost").alias("geodesic"), "hops", "path")


def _frontiers(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that a query can come by within its hops: ``qid, src, relation, dst, weight, ord``."""
    q = prepared(queries)
    most = q.agg(F.max("max_hops")).first()[0] or 0
    seen = written(q.select("qid", F.col("anchor").alias("node"), F.lit(0).alias("hop")), "reach")
    for hop in range(most - 1):
        new = seen.where(F.col("hop") == hop).join(edges, F.col("node") == F.col("src")).select("qid", F.col("dst").alias("node")).distinct()
        new = new.join(seen, ["qid", "node"], "left_anti").withColumn("hop", F.lit(hop + 1))
        after = written(seen.unionByName(new), "reach")
        dropped(seen)
        seen = after
    return seen.join(q.select("qid", "max_hops"), "qid").where("hop < max_hops").join(edges, F.col("node") == F.col("src")).select("qid", "src", "relation", "dst", "weight", "ord")


def _settled_once(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """Some weights are zero: each query's own frontier is settled with a heap, a node once, at its first pop.

    A group is what one query can reach within its hops, not the graph.
    """
    shipped(queries.sparkSession)
    q = prepared(queries)
    own = _frontiers(queries, edges).join(q, "qid")
    kind = queries.schema["qid"].dataType.simpleString()

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord", kind="stable")
        first = group.iloc[0]
        chain = [] if first["chain"] is None else list(first["chain"])
        target, most, anchor = first["target"], int(first["max_hops"]), first["anchor"]
        ahead: dict = {}
        for s, r, d, w in zip(group["src"], group["relation"], group["dst"], group["weight"], strict=True):
            ahead.setdefault(s, []).append((r, d, w))
        queue, best, settled, count, out = [(0.0, anchor, 0, ())], {anchor: 0.0}, set(), 0, []
        while queue:
            cost, node, _, path = heapq.heappop(queue)
            if node in settled:
                continue
            settled.add(node)
            if path:
                out.append((first["qid"], node, cost, len(path), [dict(zip(("source", "relation", "target", "weight"), s, strict=True)) for s in path], len(out)))
                if target is not None and node == target:
                    break
            if len(path) >= most:
                continue
            only = chain[len(path)] if len(path) < len(chain) else None
            for r, d, w in ahead.get(node, ()):
                total = cost + w
                if (only is None or r == only) and d not in settled and total < best.get(d, float("inf")):
                    best[d], count = total, count + 1
                    heapq.heappush(queue, (total, d, count, (*path, (node, r, d, w))))
        if target is not None:
            out = [x for x in out if x[1] == target]
        return pd.DataFrame(out, columns=["qid", "object_id", "geodesic", "hops", "path", "settled"])

    return own.groupBy("qid").applyInPandas(settle, f"qid {kind}, object_id string, geodesic double, hops int, path {_STEPS}, settled long").drop("settled")


def _by_rounds(queries: DataFrame, edges: DataFrame, paths: bool) -> DataFrame:
    """Unequal, positive weights: every node's state follows from its predecessors' until none changes.

    A state is a node's cost, hops and path; the least (cost, predecessor's cost, predecessor, edge
    order) is what a search that settles each node once would settle first. A node's state rests
    on cheaper ones only, so the states that reproduce themselves are the search's: right after as
    many rounds as the hops, and a few more where a cheaper, longer way ends one that was taken.
    Each round is one join with the edges and one aggregate, so a hub or a query with a large
    reach spreads over tasks.
    """
    q = written(prepared(queries), "queries")
    none = F.array().cast(_STEPS)
    start = q.select("qid", F.col("anchor").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit("").alias("src"), F.lit("").alias("relation"), none.alias("path"))
    e = edges.select(F.col("src").alias("s"), F.col("relation").alias("r"), "dst", "weight", "ord")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("qid", "node", "cost", "hops", "src", "relation").cast("decimal(38,0)"))).first())
    now, last, after = written(start, "states"), None, None
    while after is None or after != last:
        f = now.drop("src", "relation").join(q.select("qid", "anchor", "chain", "max_hops"), "qid").where(F.col("hops") < F.col("max_hops"))
        reach = f.join(e, f.node == e.s).where(_allowed(F.col("chain"), F.col("hops"), F.col("r")) & (F.col("dst") != F.col("anchor")))
        state = [(F.col("cost") + F.col("weight")).alias("total"), "cost", "s", "ord", "r", "weight", "hops", *(["path"] if paths else [])]
        best = reach.groupBy("qid", "dst").agg(F.min(F.struct(*state)).alias("p"))
        path = F.concat("p.path", F.array(step(F.col("p.s"), F.col("p.r"), F.col("dst"), F.col("p.weight")))) if paths else none
        new = best.select("qid", F.col("dst").alias("node"), F.col("p.total").alias("cost"), (F.col("p.hops") + 1).alias("hops"), F.col("p.s").alias("src"), F.col("p.r").alias("relation"), path.alias("path"))
        then = written(start.unionByName(new), "states")
        dropped(now)
        now, last, after = then, after, mark(then)
    return _to_target(now.where("hops > 0").select("qid", "node", "cost", "hops", "path"), q)


def _cheapest(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """True least cost with at most the given hops. Not what settling once finds where weights differ."""
    q = prepared(queries)
    most = q.agg(F.max("max_hops")).first()[0] or 0
    now = written(q.select("qid", F.col("anchor").alias("node"), F.lit(0.0).alias("cost"), F.array().cast(_STEPS).alias("path")), "walks")
    every = now.withColumn("hops", F.lit(0))
    for hop in range(most):
        f = now.join(q.select("qid", "anchor", "chain", "max_hops"), "qid").where(F.col("max_hops") > hop)
        reach = f.join(edges, f.node == edges.src).where(_allowed(F.col("chain"), F.lit(hop), F.col("relation")) & (F.col("dst") != F.col("anchor")))
        own = step(F.col("src"), F.col("relation"), F.col("dst"), F.col("weight"))
        walk = F.struct((F.col("cost") + F.col("weight")).alias("cost"), F.col("src"), F.col("ord"), F.concat("path", F.array(own)).alias("path"))
        new = reach.groupBy("qid", F.col("dst").alias("node")).agg(F.min(walk).alias("w")).select("qid", "node", "w.cost", "w.path")
        now = written(new, "walks")
        every = every.unionByName(now.withColumn("hops", F.lit(hop + 1)))
    least = every.where("hops > 0").groupBy("qid", "node").agg(F.min_by(F.struct("cost", "hops", "path"), F.struct("cost", "hops")).alias("b"))
    return _to_target(least.select("qid", "node", "b.cost", "b.hops", "b.path"), q)


def geodesic_paths(queries: DataFrame, edges: DataFrame, objects: DataFrame | None = None, plan: str = "auto", paths: bool = True) -> DataFrame:
    """``qid, object_id, geodesic, hops, path`` of all nodes that each query reaches.

    ``queries``: qid, anchor and optional chain, target, max_hops. A node settles once, at its
    first pop in order of (cost, id): one settled at the hop limit isn't expanded again by a
    dearer, shorter way. ``chain`` filters hop by hop and lets all relations follow it; the anchor
    is never returned; unknown anchors return nothing (``objects`` given) and so do dangling ones.

    plan: "auto" goes level by level if all weights are equal and positive, by rounds if they are
    positive, and with a heap for each query where some are zero, whose order of settling joins
    can't tell; all agree where they apply. "min" is least cost within the hops, another question.
    """
    if objects is not None:
        queries = queries.join(objects.select(F.col("id").alias("anchor")), "anchor", "left_semi")
    low, high = checked(edges)
    if plan == "auto":
        plan = "level" if low is None or (low == high and low > 0) else "rounds" if low > 0 else "heap"
    if plan == "level":
        q = prepared(queries).where("qid is not null")
        kinds = [] if paths or low is None or low <= 0 else q.select("chain", "max_hops", "target").distinct().limit(2).collect()
        if len(kinds) == 1 and kinds[0].chain is not None and kinds[0].target is None:
            return _level_in_arrays(q, edges, list(kinds[0].chain), kinds[0].max_hops, low)
        return _level_by_level(queries, edges, paths)
    if plan == "rounds":
        if low is not None and low <= 0:
            raise ValueError("rounds need positive weights")
        return _by_rounds(queries, edges, paths)
    if plan not in ("heap", "min"):
        raise ValueError("plan is auto, level, rounds, heap or min")
    return _settled_once(queries, edges) if plan == "heap" else _cheapest(queries, edges)


def detours(chains: DataFrame, edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """``qid, relations``: for each chain another way between its ends with other relations, if there is one.

    ``chains``: qid, source, relations, target. Walks of up to ``max_hops`` edges grow by one join
    a hop, and equal relation sequences at a node are one; the shortest way is taken, then the
    least in order of its relations.
    """
    e = edges.select("src", "relation", "dst").distinct()
    none = F.array().cast("array<string>")
    walks = chains.select("qid", F.col("source").alias("node"), none.alias("way"))
    found = None
    for _ in range(max_hops):
        walks = written(walks.join(e, walks.node == e.src).select("qid", F.col("dst").alias("node"), F.concat("way", F.array("relation")).alias("way")).distinct(), "walks")
        hit = walks.join(chains.select("qid", "relations", "target"), "qid").where((F.col("node") == F.col("target")) & (F.col("way") != F.col("relations"))).select("qid", "way")
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("qid").agg(F.min(F.struct(F.size("way").alias("n"), "way")).alias("b")).select("qid", F.col("b.way").alias("relations"))
