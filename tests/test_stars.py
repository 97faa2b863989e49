"""One-step nets: stars by aggregates, others by their distances; levels of a traversal."""

import random

from trailweave.operators import topology, traversal


def test_stars_and_triangles(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}", r.choice((0.0, 0.3, 1.0, 2.5, 7.0))) for _ in range(60)]
    edges += [("hub", f"leaf{k}", k * 0.7) for k in range(200)] + [("zero", "nil", 0.0)]
    e = spark.createDataFrame([(a, "x", b, w, 0) for a, b, w in edges], "src string, relation string, dst string, weight double, ord long")
    objects = e.selectExpr("explode(array(src, dst)) AS id").where("id <> 'leaf3'").distinct()
    w = {}
    for a, b, x in edges:
        if a != b:
            w[min(a, b), max(a, b)] = min(x, w.get((min(a, b), max(a, b)), x))
    want = {}
    for (i,) in objects.collect():
        net = {i} | {b for a, b in w if a == i} | {a for a, b in w if b == i}
        nodes = sorted(net)
        if len(nodes) > 1:
            d = topology.distances(len(nodes), [(nodes.index(a), nodes.index(b), x) for (a, b), x in w.items() if a in net and b in net])
            want[i] = (len(nodes), topology.signature(d).tolist())
    stars = [i for i, (_, s) in want.items() if i == "hub" or i.startswith("leaf")]
    assert {x.id: (x.n_nodes, list(x.topo_signature)) for x in topology.signatures(objects, e, 1).collect()} == want
    assert len(stars) == 200


def test_stars_need_no_distances(spark, monkeypatch):
    """A star's signature comes from aggregates: no row of it reaches the grouped function."""
    reached = []

    class Counted:
        def __init__(self, rows, data):
            self.rows, self.data = rows, data

        def __getattr__(self, name):
            if name == "applyInPandas":
                reached.append(self.rows.count())
            return getattr(self.data, name)

    kind = type(spark.range(1))
    grouped = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *by: Counted(self, grouped(self, *by)))
    e = spark.range(300).selectExpr("'hub' AS src", "'x' AS relation", "concat('leaf', id) AS dst", "1.0D + id AS weight", "id AS ord")
    (row,) = topology.signatures(spark.sql("SELECT 'hub' AS id"), e, 1).collect()
    assert row.n_nodes == 301 and sum(row.topo_signature) == 300 and reached == [0]


def test_last_level_without_paths_is_not_written(spark, monkeypatch):
    names, written = [], traversal.written
    monkeypatch.setattr(traversal, "written", lambda df, name: names.append(name) or written(df, name))
    e = spark.createDataFrame([("a", "x", "b"), ("a", "x", "c"), ("b", "x", "d"), ("c", "x", "d"), ("d", "x", "a")], "src string, relation string, dst string").selectExpr("*", "1.0D AS weight", "0L AS ord")
    asked = spark.createDataFrame([("q", "a", 2)], "qid string, anchor string, max_hops int")
    out = traversal.geodesic_paths(asked, e, paths=False)
    assert sorted((r.object_id, r.geodesic, r.hops) for r in out.collect()) == [("b", 1.0, 1), ("c", 1.0, 1), ("d", 2.0, 2)]
    assert names == ["level0"]


def test_levels_in_slices_of_lists(spark, monkeypatch):
    """Queries of one chain: the hops of a search with cycles, however few ways a slice, an array or a broadcast may have."""
    r = random.Random(5)
    edges = [(f"n{r.randrange(30)}", r.choice("xxy"), f"n{r.randrange(30)}") for _ in range(120)] + [("n1", "x", "n1")]
    e = spark.createDataFrame(edges, "src string, relation string, dst string").selectExpr("*", "0.5D AS weight", "0L AS ord")
    asked = spark.createDataFrame([(k, f"n{k}", ["x", None, "x"], 4) for k in range(12)], "qid int, anchor string, chain array<string>, max_hops int")
    want = set()
    for k in range(12):
        seen, level = {f"n{k}"}, {f"n{k}"}
        for hop, only in enumerate(("x", None, "x", None)):
            level = {b for a, kind, b in edges if a in level and only in (kind, None)} - seen
            seen |= level
            want |= {(k, b, (hop + 1) * 0.5, hop + 1) for b in level}
    written = traversal.written
    for small, ways, array in ((1 << 18, 1 << 26, 1 << 20), (2, 1 << 26, 1 << 20), (2, 40, 1 << 20), (2, 40, 9)):
        names = []
        monkeypatch.setattr(traversal, "written", lambda df, name, names=names: names.append(name) or written(df, name))
        for name, value in (("SMALL", small), ("WAYS", ways), ("ARRAY", array)):
            monkeypatch.setattr(traversal, name, value)
        got = [(x.qid, x.object_id, x.geodesic, x.hops) for x in traversal.geodesic_paths(asked, e, paths=False).collect()]
        assert len(got) == len(want) and set(got) == want
        assert (names.count("level1") > 1) == (ways == 40)


def test_null_targets_of_one_chain(spark, monkeypatch):
    e = spark.createDataFrame([("a", "x", None), ("a", "x", "b"), (None, "x", "c"), ("b", "y", None)], "src string, relation string, dst string").selectExpr("*", "1.0D AS weight", "0L AS ord")
    asked = spark.createDataFrame([("q", "a", ["x", "y"], 2)], "qid string, anchor string, chain array<string>, max_hops int")
    for small in (1 << 18, 0):
        monkeypatch.setattr(traversal, "SMALL", small)
        got = [(x.object_id, x.hops) for x in traversal.geodesic_paths(asked, e, paths=False).collect()]
        assert sorted(got, key=repr) == [("b", 1), (None, 1), (None, 2)]


def test_reach_writes_no_edges(spark, sf_dir, monkeypatch):
    """The edges of all relations, several times the input, aren't written or moved for a chain."""
    from trailweave import queries
    from trailweave.sources import documents

    names, written = [], documents.written
    monkeypatch.setattr(documents, "written", lambda df, name: names.append(name) or written(df, name))
    monkeypatch.setattr(documents, "_LOADED", {})
    queries.path_reach_khop(spark, sf_dir)
    assert names == []
