"""Queries over whole inputs."""

from trailweave import queries
from trailweave.operators import topology
from trailweave.plans.query import query
from trailweave.sources import documents as D


def test_modes_with_topology_compute_signatures(spark):
    objects, edges = D.demo(spark, "umbrella")
    asked = spark.createDataFrame([(0, "umbrella")], "qid int, anchor string")
    rows = lambda mode, **own: {r.object_id: r for r in query(asked, objects, edges, mode, 20, **own).collect()}
    given = topology.signatures(objects, edges)
    for mode in ("topo", "reasoning", "full"):
        got = rows(mode)
        assert got == rows(mode, signatures=given) and any("topo" in r.components for r in got.values())


def test_procrustes_takes_whole_embeddings(spark, sf_dir):
    out = queries.procrustes(spark, sf_dir)
    rows = out.collect()
    assert {(r.i, r.j) for r in rows} == {(i, j) for i in range(64) for j in range(64)}
