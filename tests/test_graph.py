import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.functions.vocabulary import Vocabulary
from trailweave.operators.components import connected_components
from trailweave.operators.onehop import contradictions, direct, neighbors
from trailweave.operators.traversal import geodesic_paths
from trailweave.plans.query import blast_radius, graph_export, query
from trailweave.sources import documents as D


def edges_of(spark, rows):
    full = [(s, r, d, float(w), k) for k, (s, r, d, w) in enumerate(rows)]
    return spark.createDataFrame(full, "src string, relation string, dst string, weight double, ord bigint")


def asked(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "qid bigint, anchor string, relation string, target string, max_hops int")


def test_vocabulary(spark):
    v = Vocabulary()
    assert len(v.names()) == 20 and v.inverse_of("prevents") == "prevented_by" and v.inverse_of("contradicts") == "contradicts" and v.inverse_of("x") is None
    w = v.register("wets", inverse="wetted_by")
    assert w.inverse_of("wetted_by") == "wets" and "wets" not in v and w.properties("nothing") == Vocabulary().properties("else")
    assert v.frame(spark).where("symmetric").count() == 4


def test_direct_and_virtual_inverse(spark):
    _, edges = D.demo(spark, "umbrella")
    rows = {(r.qid, r.object_id): r for r in direct(asked(spark, ("rain", "prevented_by", None, None), ("umbrella", "prevents", None, None), ("umbrella", None, None, None)), edges).collect()}
    assert set(rows) == {(0, "umbrella"), (1, "rain"), (2, "rain")}
    assert rows[0, "umbrella"].path[0].asDict() == {"source": "umbrella", "relation": "prevents", "target": "rain", "weight": 1.0}


def test_inverse_results_leave_out_what_is_found_already(spark):
    e = edges_of(spark, [("a", "part_of", "b", 2), ("b", "has_part", "a", 1), ("c", "has_part", "a", 1), ("c", "has_part", "a", 3)])
    got = sorted((r.object_id, r.path[0].source) for r in direct(asked(spark, ("a", "part_of", None, None)), e).collect())
    assert got == [("b", "a"), ("c", "c")]


def test_contradictions_both_ways(spark):
    _, edges = D.demo(spark, "umbrella")
    q = asked(spark, ("rain", None, None, None), ("sunshine", None, None, None), ("storm", None, None, None))
    assert sorted((r.qid, r.object_id) for r in contradictions(q, edges).collect()) == [(0, "sunshine"), (1, "rain")]
    assert {r.src: r.targets for r in neighbors(edges).collect()}["umbrella"] == ["rain"]


def test_settles_once(spark):
    e = edges_of(spark, [("A", "r", "B", 5), ("A", "r", "C", 1), ("C", "r", "B", 1), ("B", "r", "D", 1)])
    q = asked(spark, ("A", None, None, 2))
    assert {r.object_id: r.geodesic for r in geodesic_paths(q, e).collect()} == {"B": 2.0, "C": 1.0}
    assert {r.object_id: r.geodesic for r in geodesic_paths(q, e, plan="min").collect()} == {"B": 2.0, "C": 1.0, "D": 6.0}
    with pytest.raises(ValueError):
        geodesic_paths(q, edges_of(spark, [("A", "r", "B", -1)]))


def test_chain_is_a_prefix_filter_and_target_stops(spark):
    e = edges_of(spark, [("a", "x", "b", 1), ("a", "y", "c", 1), ("b", "z", "d", 1), ("d", "x", "a", 1), ("d", "w", "e", 1)])
    q = spark.createDataFrame([(0, "a", ["x"], None, None), (1, "a", ["x", "q"], None, None), (2, "a", None, "d", None), (3, "a", None, "a", None), (4, "none", None, None, 0)], "qid int, anchor string, chain array<string>, target string, max_hops int")
    for plan in ("level", "rounds", "heap"):
        got = sorted((r.qid, r.object_id, r.hops) for r in geodesic_paths(q, e, plan=plan).collect())
        assert got == [(0, "b", 1), (0, "d", 2), (0, "e", 3), (1, "b", 1), (2, "d", 2)], plan


def heap_answer(edges, anchor, most):
    """Plain settle-once search on the driver."""
    import heapq

    ahead = {}
    for s, r, d, w in edges:
        ahead.setdefault(s, []).append((r, d, w))
    queue, best, done, out = [(0.0, anchor, 0)], {anchor: 0.0}, set(), {}
    while queue:
        cost, node, hops = heapq.heappop(queue)
        if node in done:
            continue
        done.add(node)
        if hops:
            out[node] = (cost, hops)
        if hops < most:
            for _, d, w in ahead.get(node, ()):
                if d not in done and cost + w < best.get(d, np.inf):
                    best[d] = cost + w
                    heapq.heappush(queue, (cost + w, d, hops + 1))
    return out


def test_plans_agree_with_a_plain_search(spark):
    r = random.Random(4)
    rows = sorted({(f"n{r.randrange(40)}", r.choice("xy"), f"n{r.randrange(40)}") for _ in range(160)})
    for weights in ([1.0], [1.0, 2.0, 5.0]):
        own = [(s, k, d, r.choice(weights)) for s, k, d in rows if s != d]
        least = {}
        for s, k, d, w in own:
            least[s, d] = min(w, least.get((s, d), 9))
        q = asked(spark, *[(f"n{i}", None, None, 3) for i in range(12)])
        got = {}
        for x in geodesic_paths(q, edges_of(spark, own)).collect():
            got.setdefault(x.qid, {})[x.object_id] = (x.geodesic, x.hops)
            assert x.path[0].source == f"n{x.qid}" and x.path[-1].target == x.object_id and sum(p.weight for p in x.path) == x.geodesic
        for i in range(12):
            assert got.get(i, {}) == heap_answer(own, f"n{i}", 3)


def test_rounds_are_the_search(spark):
    """Costs, hops and paths of graphs where longer ways are cheaper, against the heap; chains and targets too."""
    r = random.Random(8)
    for trial in range(3):
        rows = sorted({(f"n{r.randrange(25)}", r.choice("xy"), f"n{r.randrange(25)}") for _ in range(110)})
        e = edges_of(spark, [(s, k, d, r.choice([1.0, 1.0, 2.0, 7.5])) for s, k, d in rows])
        q = spark.createDataFrame([(i, f"n{i}", [None, ["x"], ["y", "x"]][i % 3], f"n{i + 3}" if i % 4 == 0 else None, 2 + i % 3) for i in range(12)], "qid int, anchor string, chain array<string>, target string, max_hops int")
        same = lambda plan: sorted(geodesic_paths(q, e, plan=plan).collect(), key=repr)
        assert same("rounds") == same("heap"), trial
    with pytest.raises(ValueError):
        geodesic_paths(q, edges_of(spark, [("a", "x", "b", 0.0)]), plan="rounds")
    zero = edges_of(spark, [("a", "x", "b", 0.0), ("b", "x", "c", 1.0)])
    assert {x.object_id: x.geodesic for x in geodesic_paths(asked(spark, ("a", None, None, 3)), zero).collect()} == {"b": 0.0, "c": 1.0}


def test_query_text_and_modes(spark):
    objects, edges = D.demo(spark, "umbrella")
    q = spark.createDataFrame([(0, "what prevents rain?"), (1, "is umbrella connected to wet_coat?"), (2, "nothing known"), (3, None)], "qid int, text string")
    for mode in ("graph", "reasoning"):
        rows = [r for r in query(q, objects, edges, mode).collect()]
        assert sorted((r.qid, r.object_id) for r in rows) == [(0, "umbrella"), (1, "wet_coat")]
    two = next(r for r in rows if r.qid == 1)
    assert two.content == "a coat soaked by water" and two.explain.startswith("umbrella --[prevents]--> rain --[causes]--> wet_coat  (score=") and two.hops == 2
    with pytest.raises(ValueError):
        query(q, objects, edges, "nonsense")


def test_dependencies(spark):
    objects, edges = D.demo(spark, "deps")
    services = objects.where("id in ('checkout_api', 'auth_service', 'billing_worker', 'docs_portal')").select("id")
    assert {r.id for r in blast_radius(services, "CVE_2024_5001", edges).collect()} == {"checkout_api", "auth_service", "billing_worker"}
    got = query(asked(spark, ("checkout_api", None, "CVE_2024_5001", None)), objects, edges, "graph").first()
    assert [p.relation for p in got.path] == ["depends_on", "depends_on", "affected_by"] and got.score == 1.5
    assert graph_export(objects.where("id <> 'bignum'"), edges).where("dangling").first().id == "bignum"


def test_components(spark):
    r = random.Random(9)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {}
    for a, b in pairs:
        if a is not None and a != b:
            for x in (a, b):
                root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and a != b:
                m = min(root[a], root[b])
                changed |= root[a] != m or root[b] != m
                root[a] = root[b] = m
    assert got == root
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents(spark):
    rows = [{"id": "a", "text": "t", "edges": [("r", "b"), ("s", "c", 2), {"relation": "r", "target": "b", "weight": 3}]}, {"_id": "", "id": "d", "content": ""}, {"content": "fresh"}]
    objects, edges = D.split_documents(D.documents(spark, rows))
    assert {r.id for r in objects.collect()} >= {"a", "d"} and objects.count() == 3
    assert sorted((r.relation, r.dst, r.weight) for r in edges.collect()) == [("r", "b", 3.0), ("s", "c", 2.0)]
    with pytest.raises(TypeError):
        D.edge_row("no")
    assert '"relation":"s"' in D.to_json(objects, edges).where("id = 'a'").first().json


def test_random_graph(spark):
    objects, edges = D.random_graph(spark, 500, 4)
    assert objects.count() == 500 and edges.where("src = dst").count() == 0 and edges.groupBy("src").count().where("count > 4").count() == 0
    assert edges.select(F.countDistinct("relation")).first()[0] == 5
