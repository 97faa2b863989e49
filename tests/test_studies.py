import json

import numpy as np
from pyspark.sql import functions as F

from trailweave.operators import hooks, sheaf
from trailweave.operators.traversal import detours
from trailweave.plans import evaluate
from trailweave.plans.query import query, results_json
from trailweave.sources import documents as D


def test_text_stalks(spark):
    rows = [("a", "red apple"), ("b", "red apple"), ("c", "blue"), ("d", None), ("e", "")]
    got = {r.id: np.array(r.sheaf_stalk) for r in sheaf.text_stalks(spark.createDataFrame(rows, "id string, text string"), 8).collect()}
    assert set(got) == {"a", "b", "c"} and np.allclose(got["a"], got["b"]) and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())


def test_detours(spark):
    e = spark.createDataFrame([("a", "x", "b"), ("b", "y", "c"), ("a", "z", "c"), ("a", "w", "d")], "src string, relation string, dst string")
    c = spark.createDataFrame([(1, "a", ["x", "y"], "c"), (2, "a", ["w"], "d")], "qid int, source string, relations array<string>, target string")
    assert [(r.qid, r.relations) for r in detours(c, e).collect()] == [(1, ["z"])]


def test_probe(spark):
    rows = []
    for k in range(30):
        a, b, c = f"ent {k} a", f"ent {k} b", f"ent {k} c"
        rows.append((f"q{k}", "where?", c, "t", [(a, "made by", b), (b, "born in", c)], [(a, f"{a} stands alone"), (b, f"{b} makes things"), (c, f"{c} is a place")]))
    ex = spark.createDataFrame(rows, "qid string, question string, answer string, qtype string, evidences array<struct<s:string,r:string,o:string>>, context array<struct<title:string,text:string>>")
    out = evaluate.run_probe(ex, dim=4)
    got = {(r.maps, r.kind): r for r in out.collect()}
    assert {m for m, _ in got} == {"placeholder", "identity", "learned"} and got["identity", "shuffle"].auc == 0.5
    assert all(0 <= r.auc <= 1 and not r.degenerate for r in got.values())
    assert evaluate.verdict(out, 2.0) == "no signal"


def test_hooks(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id int, text string")
    got = hooks.extract_with(docs, lambda x: [(x, "causes", "b"), (x, "invented", "b")]).collect()
    assert [(r.doc_id, r.subject, r.relation, r.object) for r in got] == [(1, "a", "causes", "b")]
    names = spark.createDataFrame([("red war",), ("red",), ("blue sky",)], "name string")
    q = spark.createDataFrame([(1, "who made Red War?"), (2, "the blue sky")], "qid int, text string")
    assert {r.qid: r.name for r in hooks.link_with(q, names, lambda t, o: "Red!" if "Red" in t else None).collect()} == {1: "red", 2: "blue sky"}


def test_exports(spark):
    objects, edges = D.demo(spark, "umbrella")
    got = {r.id: r for r in sheaf.stalk_export(objects.where("id <> 'rain'"), edges).collect()}
    assert got["rain"].dangling and np.allclose(got["storm"].stalk, sheaf.default_stalk("storm", 3))
    q = spark.createDataFrame([(0, "umbrella")], "qid int, anchor string")
    found = json.loads(results_json(query(q, objects, edges, "graph")).first().json)
    assert [x["rank"] for x in found] == list(range(1, len(found) + 1)) and found[0]["object_id"] == "rain" and found[0]["components"]["geodesic"] == 1.0
    assert objects.where(F.col("id") == "rain").count() == 1


def test_reports(spark):
    rows = spark.createDataFrame([(2, 0.25), (1, 0.5)], "hops int, accuracy double")
    assert evaluate.report("projection", rows) == "## Accuracy over hops\n\n| hops | accuracy |\n|---|---|\n| 1 | 0.500 |\n| 2 | 0.250 |"
    assert json.loads(evaluate.report("projection", rows, "json")) == {"report": "projection", "rows": [{"hops": 1, "accuracy": 0.5}, {"hops": 2, "accuracy": 0.25}]}
    many = spark.range(2500).withColumn("x", F.lit(None).cast("double"))
    assert evaluate.markdown(many, ["id", "x"]).count("n/a") == 2500


def test_scale_run(spark):
    (row,) = evaluate.run_scale(spark, (200,), 50).collect()
    assert row.objects == 200 and row.anchors == 50 and row.anchors_per_second > 0
