import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from trailweave.functions import text as X
from trailweave.functions import vectors as V
from trailweave.functions.vocabulary import Vocabulary
from trailweave.operators import extraction, metrics, retrieval, sheaf, topology
from trailweave.plans import evaluate
from trailweave.sources import documents as D


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, X.tokens, "A b-C3 é") == ["a", "b", "c3"]
    assert one(spark, X.normalised, "  Polish--Russian War (film)! ") == "polish russian war film"
    assert one(spark, X.slug, " Place of\tBirth ") == "place_of_birth"
    assert one(spark, X.without_articles, "The cat, an owl & a dog") == "cat owl dog"
    assert one(spark, X.alias_keys, "War (film)") == ["war film", "war"] and one(spark, X.alias_keys, "War") == ["war"]


def test_similarity(spark):
    rows = [([1.0, 0.0], [2.0, 0.0], 1.0), ([0.0], [0.0], 1.0), ([0.0], [1.0], 0.0), (None, [1.0], 0.0), ([1.0, 0.0], [0.0, 1.0], math.exp(-math.sqrt(2)))]
    for r in spark.createDataFrame(rows, "a array<double>, b array<double>, s double").select("s", V.similarity(F.col("a"), F.col("b")).alias("got")).collect():
        assert abs(r.s - r.got) < 1e-12
    assert spark.range(1).select(F.size(V.probe_codes(F.lit(5).cast("bigint"), 16, 2))).first()[0] == 137


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = np.abs(rng.standard_normal((8, 32)))
    rows = [(f"c{c}_{k}", np.abs(centres[c] + 0.05 * rng.standard_normal(32)).tolist()) for c in range(8) for k in range(20)]
    entries = spark.createDataFrame(rows, "id string, vector array<double>")
    asked = entries.where("endswith(id, '_0')").withColumnRenamed("id", "qid")
    exact = topology.exact_top(asked, entries, 5)
    near = topology.near_top(asked, topology.index(entries, 32, 12, tables=4), 32, 5, 2, 12, tables=4)
    assert topology.recall(exact, near).first().recall >= 0.9
    one = topology.near_top(asked, topology.index(entries, 32, 12), 32, 5, 2, 12)
    assert topology.recall(exact, one).first().recall >= 0.8
    assert [tuple(r) for r in topology.exact_top(asked, entries, 5, block=3).orderBy("qid", "rank").collect()] == [tuple(r) for r in exact.orderBy("qid", "rank").collect()]
    assert topology.exact_top(asked.where("false"), entries).count() == 0 and topology.sketch_top(asked.where("false"), entries).count() == 0
    assert near.where("rank = 1 and qid = id and similarity > 0.99").count() == 8
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows}
    for q in asked.collect():
        want = sorted(v, key=lambda i: (round(np.linalg.norm(v[i] - v[q.qid]), 9), i))[:5]
        assert [r.id for r in exact.where(F.col("qid") == q.qid).orderBy("rank").collect()] == want


def test_shapes():
    for n in range(4, 13):
        d = topology.distances(n, [(k, (k + 1) % n, 1.0) for k in range(n)])
        assert topology.deaths_of_components(d) == [1.0] * (n - 1)
        assert topology.loops(d) == ([(1.0, float(math.ceil(n / 3)))] if math.ceil(n / 3) > 1 else [])
    two = topology.distances(4, [(0, 1, 1.0), (2, 3, 2.0)])
    assert two[0, 2] == 5.0 and sorted(topology.deaths_of_components(two)) == [1.0, 2.0, 5.0]
    s = topology.signature(two)
    assert len(s) == 64 and s[:32].sum() == 3 and s[31] == 1 and s[32:].sum() == 0 and not topology.signature(np.zeros((1, 1))).any()


def all_loops(d):
    """H1 bars by reducing every triangle of the full complex."""
    from itertools import combinations

    n = len(d)
    edges = sorted(combinations(range(n), 2), key=lambda e: (d[e], e))
    place = {e: k for k, e in enumerate(edges)}
    reduced, out = {}, []
    for last, sides in sorted((max(place[a, b], place[a, c], place[b, c]), (place[a, b], place[a, c], place[b, c])) for a, b, c in combinations(range(n), 3)):
        column = set(sides)
        while column and max(column) in reduced:
            column ^= reduced[max(column)]
        if column:
            reduced[max(column)] = column
            bar = (float(d[edges[max(column)]]), float(d[edges[last]]))
            out += [bar] if bar[1] > bar[0] else []
    return sorted(out)


def test_loops_are_those_of_the_full_complex():
    r = random.Random(6)
    for _ in range(60):
        n = r.randrange(3, 13)
        d = topology.distances(n, [(r.randrange(n), r.randrange(n), float(r.choice([1, 1, 2, 3.5]))) for _ in range(r.randrange(n, 3 * n))])
        assert sorted(topology.loops(d)) == all_loops(d)
    wheel = topology.distances(301, [(k, (k + 1) % 300, 1.0) for k in range(300)] + [(300, k, 10.0) for k in range(300)])
    assert topology.loops(wheel) == [(1.0, 10.0)]


def test_signatures_of_a_graph(spark):
    objects, edges = D.demo(spark, "umbrella")
    got = {r.id: r for r in topology.signatures(objects, edges).collect()}
    assert set(got) == {r.id for r in objects.collect()} and got["rain"].n_nodes == 6
    assert {r.id for r in topology.affected(objects.where("id = 'storm'"), edges).collect()} == {"storm", "rain", "umbrella", "wet_coat", "sunshine"}


def test_maps_are_orthogonal_and_inverse():
    for r in ("causes", "caused_by", "unknown"):
        m = sheaf.restriction_map(r, 8)
        assert np.allclose(m @ m.T, np.eye(8))
    assert np.allclose(sheaf.restriction_map("causes", 8), sheaf.restriction_map("caused_by", 8).T)
    x = sheaf.default_stalk("a", 16)
    assert abs(np.linalg.norm(x) - 1) < 1e-12 and sheaf.residual(x, x, []) == 0.0
    assert sheaf.residual(x, sheaf.restriction_map("causes", 16) @ x, ["causes"]) < 1e-12
    assert sheaf.trace([("a", "causes", "b")])[0]["residual"] == sheaf.residual(x, sheaf.default_stalk("b", 16), ["causes"])


def test_learned_maps(spark):
    rng = np.random.default_rng(0)
    truth = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    stalks, edges = [], []
    for k in range(40):
        x = rng.standard_normal(6)
        stalks += [(f"a{k}", x.tolist()), (f"b{k}", (truth @ x).tolist())]
        edges.append((f"a{k}", "causes", f"b{k}") if k % 2 else (f"b{k}", "caused_by", f"a{k}"))
    table = spark.createDataFrame(stalks, "id string, sheaf_stalk array<double>")
    maps = sheaf.learned_maps(spark.createDataFrame([*edges, ("a1", "lost", "none")], "src string, relation string, dst string"), table)
    assert np.allclose(maps["causes"], truth) and np.allclose(maps["caused_by"], truth.T) and set(maps) == {"causes", "caused_by"}
    rows = spark.createDataFrame([("a1", [("a1", "causes", "b1", 1.0)], "b1")], "anchor string, path array<struct<source:string,relation:string,target:string,weight:double>>, object_id string")
    assert sheaf.residuals(rows, 6, table, Vocabulary(), maps).first().sheaf < 1e-9


def test_extraction(spark):
    rows = [(1, "The umbrella prevents the rain. Nothing here; x is a y\nA, causes"), (2, None), (3, ""), (4, "is amber"), (5, "This Depends on that")]
    got = [(r.doc_id, r.subject, r.relation, r.object) for r in extraction.extract_triples(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("doc_id", "sentence").collect()]
    assert got == [(1, "The umbrella", "prevents", "the rain"), (1, "x", "is_a", "y"), (5, "This", "requires", "on that")]
    r = evaluate.run_extraction(spark).first()
    assert (r.n_predicted, r.n_exact, round(r.f1, 3)) == (13, 8, 0.516)


def test_intents(spark):
    ids = spark.createDataFrame([("Rain",), ("raincoat",), ("umbrella",), ("x",), ("",)], "id string")
    rows = [(1, "what prevents rain?"), (2, "does umbrella prevent RAIN"), (3, "raincoat"), (4, "is umbrella similar to things"), (5, None), (6, "")]
    got = {r.qid: (r.anchor, r.relation, r.target) for r in extraction.parse_intents(spark.createDataFrame(rows, "qid int, text string"), ids).collect()}
    assert got == {1: ("Rain", "prevented_by", None), 2: ("umbrella", "prevents", "Rain"), 3: ("raincoat", None, "Rain"), 4: ("umbrella", "similar_to", None), 5: (None, None, None), 6: (None, None, None)}


def test_bm25_and_tfidf_by_hand(spark):
    docs = {"a": "red apple red", "b": "green apple", "c": "blue sky", "d": None}
    table = spark.createDataFrame(list(docs.items()), "id string, text string")
    q = spark.createDataFrame([(1, "red apple apple"), (2, "nothing")], "qid int, text string")
    idf = lambda d: max(1e-6, math.log((4 - d + 0.5) / (d + 0.5) + 1))
    part = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (7 / 4)))
    got = {(r.qid, r.id): r.score for r in retrieval.bm25(q, table).collect()}
    assert set(got) == {(1, "a"), (1, "b")}
    assert abs(got[1, "a"] - (idf(1) * part(2, 3) + 2 * idf(2) * part(1, 3))) < 1e-8
    rows = [(r.qid, r.id) for r in retrieval.tfidf(q, table, 3).orderBy("qid", "rank").collect()]
    assert rows == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c")]
    floor = retrieval.random_top(q, table, 3).collect()
    assert len(floor) == 6 and len({(r.qid, r.id) for r in floor}) == 6


def test_auc_and_percentiles(spark):
    r = random.Random(3)
    rows = [(float(r.randrange(12)), r.random() < 0.4) for _ in range(400)]
    p, n = [s for s, k in rows if k], [s for s, k in rows if not k]
    want = sum((a < b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    table = spark.createDataFrame(rows, "score double, positive boolean")
    assert abs(metrics.auc(table).first().auc - want) < 1e-12 and metrics.auc(table.where("positive")).first().auc is None
    values = sorted(s for s, _ in rows)
    for x in metrics.nearest_rank(table.withColumn("g", F.lit(1)), "score", [0, 50, 95, 100], ["g"]).collect():
        assert x.value == values[max(1, min(400, round(x.percent / 100 * 400))) - 1]


def test_retrieval_metrics(spark):
    q = spark.createDataFrame([(1, "k", ["a", "b"], ["r"]), (2, "k", ["z"], None), (3, "m", ["c"], [])], "qid int, kind string, answers array<string>, gold_path array<string>")
    res = spark.createDataFrame([(1, "x", 1, ["q"]), (1, "a", 2, ["r"]), (1, "b", 3, ["s"]), (3, "c", 1, None)], "qid int, object_id string, rank int, relations array<string>")
    got = {r.qid: r for r in metrics.retrieval_metrics(res, q, 5).collect()}
    assert (got[1].hits_at_1, got[1].hits_at_k, got[1].precision_at_k, got[1].recall_at_k, got[1].reciprocal_rank, got[1].path_correct) == (0, 1, 0.4, 1, 0.5, 1)
    assert got[2].hits_at_k == 0 and got[2].path_correct is None and got[3].hits_at_1 == 1 and got[3].path_correct is None
    assert metrics.summarised(metrics.retrieval_metrics(res, q, 5)).count() == 3


def test_examples(spark, tmp_path):
    raw = [
        {"_id": "q1", "type": "compositional", "question": "Where was the maker of Red War born?", "answer": "Old Town", "evidences": [["Red War (film)", "director", "Ann Lee"], ["Ann Lee", "place of birth", "Old Town"]], "context": [["Red War (film)", ["Red War is a film", "by Ann Lee."]], ["Ann Lee", ["Ann Lee makes films."]]]},
        {"_id": "q2", "type": "comparison", "question": "Are both old?", "answer": "yes", "evidences": [["A", "r", "B"]], "context": []},
        {"_id": "q3", "question": "none", "answer": "x", "evidences": [], "context": []},
    ]
    path = tmp_path / "e.json"
    path.write_text(json.dumps(raw))
    ex = D.read_examples(spark, str(path)).cache()
    assert sorted(r.qid for r in ex.collect()) == ["q1", "q2"] and D.read_examples(spark, str(path), 1).count() == 1
    objects, edges = D.examples_graph(ex)
    assert objects.where("id = 'red war film'").first().content == "Red War is a film by Ann Lee." and edges.count() == 3
    rows = {(r.retriever, r.kind): r for r in evaluate.run_examples(ex).collect()}
    assert rows["engine-graph", None].hits_at_k == 1.0 and rows["engine-graph", None].path_correct == 1.0 and rows["bm25", None].path_correct is None
    linked = {(r.retriever, r.kind): r for r in evaluate.run_examples(ex, modes=("graph",), linker="surface").collect()}
    assert linked["engine-graph", None].n == 1
    chains = evaluate.chains(ex).collect()
    assert {c.qid: c.target for c in chains} == {"q1": "old town", "q2": "b"}
    kinds = {r.kind for r in evaluate.corrupted(evaluate.chains(ex)).where("qid = 'q1'").collect()}
    assert {"relation_swap", "shuffle", "tail_swap", "source_swap"} <= kinds
    assert evaluate.entity_texts(ex).where("id = 'red war' and from_paragraph").count() == 1
    assert evaluate.markdown(metrics.projected_accuracy(spark, 0.5, 2), ["hops", "accuracy"]).endswith("| 2 | 0.250 |")


def test_worlds(spark):
    rows = {(r.retriever, r.kind): r for r in evaluate.run_worlds(spark, 8, modes=("graph",)).collect()}
    best = rows["engine-graph", None]
    assert (best.hits_at_1, best.reciprocal_rank, best.path_correct) == (1.0, 1.0, 1.0)
    assert rows["lexical", None].reciprocal_rank < 1 and rows["random", None].hits_at_k < 0.5
