"""Queries through the store, streams, questions in words and evaluation tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.cluster import deleted, shared_dir, written
from trailweave.functions.vocabulary import Vocabulary
from trailweave.operators import hooks, metrics
from trailweave.operators.traversal import detours as other_ways
from trailweave.plans import evaluate
from trailweave.plans.query import clamped, query
from trailweave.sources import documents as D
from trailweave.sources.store import CHANGES, GraphStore, full_edges, full_objects, open_store
from trailweave.streaming.feed import apply_changes, change_stream, requests_per_minute, run_to_end

VOCABULARY = Vocabulary().register("located_in", inverse="location_of")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trailweave/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _key(kind: str, column) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(column) if isinstance(column, str) else column).cast("string"))


def _nations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) of nations and regions: n part_of r."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    objects = n.select(_key("n", "n_nationkey").alias("id"), F.col("n_name").alias("content")).unionByName(r.select(_key("r", "r_regionkey").alias("id"), F.col("r_name").alias("content")))
    return objects, n.select(_key("n", "n_nationkey").alias("src"), F.lit("part_of").alias("relation"), _key("r", "n_regionkey").alias("dst"), F.lit(1.0).alias("weight"))


def _suppliers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = _t(spark, sf_dir, "supplier")
    return s.select(_key("s", "s_suppkey").alias("id"), F.col("s_name").alias("content")), s.select(_key("s", "s_suppkey").alias("src"), F.lit("located_in").alias("relation"), _key("n", "s_nationkey").alias("dst"), F.lit(1.0).alias("weight"))


def _numbered(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.where(F.pmod(F.regexp_extract(key, r"(\d+)$", 1).cast("int"), F.lit(n)) == 0)


def _rows(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects and edges as one table."""
    none = F.lit("")
    return objects.select(F.col("id").alias("src"), none.alias("relation"), none.alias("dst"), F.lit(0.0).alias("weight"), "content").unionByName(edges.select("src", "relation", "dst", "weight", none.alias("content")))


def store_replay(spark, sf_dir):
    """Upserts, deletes and upserts again, read by a follower from snapshot and changes."""
    path = _folder(spark)
    store = GraphStore(spark, path)
    objects, edges = _nations(spark, sf_dir)
    store.put(objects, edges)
    store.put(*_suppliers(spark, sf_dir))
    store.compact()
    n = objects.where("startswith(id, 'n:')")
    store.delete(_numbered(n, "id", 5))
    store.put(_numbered(n, "id", 10).withColumn("content", F.concat(F.lit("again "), "content")))
    follower = GraphStore(spark, path, read_only=True)
    return _rows(follower.objects, follower.edges)


def store_update(spark, sf_dir):
    """New content and one more edge for the nations of region 0; an unknown id is left out."""
    store = GraphStore(spark, _folder(spark))
    store.put(*_nations(spark, sf_dir))
    n = _t(spark, sf_dir, "nation").where("n_regionkey = 0")
    patches = n.select(_key("n", "n_nationkey").alias("id"), F.concat(F.lit("new "), "n_name").alias("content")).unionByName(spark.createDataFrame([("n:none", "x")], "id string, content string"))
    more = n.select(_key("n", "n_nationkey").alias("src"), F.lit("related_to").alias("relation"), F.lit("r:1").alias("dst"), F.lit(2.0).alias("weight"))
    store.update(patches, more)
    return _rows(store.objects, store.edges)


def store_insert_text(spark, sf_dir):
    """What the rules extract from all documents, as a graph."""
    store = GraphStore(spark, _folder(spark))
    store.insert_text(_t(spark, sf_dir, "documents").select("text"))
    return _rows(store.objects, store.edges)


def store_scan(spark, sf_dir):
    """Point reads, ordered reads of several, both directions of edges, targets that are no objects."""
    objects, edges = _nations(spark, sf_dir)
    store = open_store(spark, "memory")
    store.put(objects.where("startswith(id, 'n:')"), edges)
    asked = spark.createDataFrame([("n:9", 0), ("none", 1), ("n:2", 2)], "id string, ord int")
    parts = [
        store.get("n:3").select(F.lit("get").alias("op"), "id", F.col("content").alias("value")), store.get_many(asked).select(F.lit("many").alias("op"), "id", F.col("ord").cast("string").alias("value")),
        store.out_edges("n:3").select(F.lit("out").alias("op"), F.col("dst").alias("id"), F.col("relation").alias("value")), store.in_edges("r:1").select(F.lit("in").alias("op"), F.col("src").alias("id"), F.col("relation").alias("value")),
        store.dangling().select(F.lit("dangling").alias("op"), "id", F.lit("").alias("value")), spark.createDataFrame([("count", "", str(len(store))), ("has", "n:1", str("n:1" in store)), ("has", "r:1", str("r:1" in store))], "op string, id string, value string"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def store_backup(spark, sf_dir):
    """A transaction, a snapshot, a backup, a delete in the store, and the backup restored beside it."""
    store = GraphStore(spark, _folder(spark))
    (a, b), (c, d) = _nations(spark, sf_dir), _suppliers(spark, sf_dir)
    with store.transaction() as t:
        t.put(a, b)
        t.put(c, d)
    store.compact()
    store.vacuum()
    copy = store.backup(_folder(spark))
    store.delete(c.select("id"))
    again = GraphStore.restore(spark, copy.path, _folder(spark))
    counted = lambda s, name: s.edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).withColumn("store", F.lit(name))
    return counted(store, "store").unionByName(counted(again, "restored"))


def store_parallel(spark, sf_dir):
    """Edges of one key side by side, and as the last one only."""
    _, edges = _nations(spark, sf_dir)
    both = full_edges(edges).withColumn("ord", F.lit(0).cast("long")).unionByName(full_edges(edges.withColumn("weight", F.lit(3.0))).withColumn("ord", F.lit(1).cast("long")))
    out = None
    for kind in ("multi", "durable"):
        store = open_store(spark, kind, _folder(spark))
        store.put(edges.select(F.col("src").alias("id"), F.lit("").alias("content")), both)
        part = store.edges.select(F.lit(kind).alias("kind"), "src", "dst", "weight")
        out = part if out is None else out.unionByName(part)
    return out


def store_signatures(spark, sf_dir):
    """Signatures kept in a store, brought up to date after a delete; how many were computed each time."""
    store = GraphStore(spark, _folder(spark))
    objects, edges = _nations(spark, sf_dir)
    store.put(objects, edges)
    first = store.reindex(1)
    store.delete(spark.createDataFrame([("n:0",)], "id string"))
    second = store.reindex(1)
    last = store.reindex(1)
    own = store.signatures().select("id", "n_nodes", F.aggregate("topo_signature", F.lit(0.0), lambda a, x: a + x).alias("bars"))
    return own.withColumns({"first": F.lit(first).cast("long"), "second": F.lit(second).cast("long"), "last": F.lit(last).cast("long")})


def change_feed(spark, sf_dir):
    """A stream of changes applied to a store, batch by batch."""
    feed, marks, store = _folder(spark), _folder(spark), GraphStore(spark, _folder(spark))
    objects, edges = _nations(spark, sf_dir)
    own = edges.groupBy(F.col("src").alias("id")).agg(F.collect_list(F.struct("relation", "dst", "weight", F.lit(None).cast("string").alias("meta"), F.lit(0).cast("long").alias("ord"))).alias("edges"))
    put = full_objects(objects).join(own, "id", "left").select(F.lit(1).cast("long").alias("seq"), F.lit("put").alias("op"), "id", "content", "vector", "meta", "edges")
    put.write.parquet(feed)
    apply_changes(change_stream(spark, feed), store, marks).awaitTermination()
    none = [F.lit(None).cast(k).alias(c) for c, k in (("content", "string"), ("vector", "array<double>"), ("meta", "string"), ("edges", spark.createDataFrame([], CHANGES).schema["edges"].dataType))]
    _numbered(objects, "id", 2).select(F.lit(2).cast("long").alias("seq"), F.lit("delete").alias("op"), "id", *none).write.mode("append").parquet(feed)
    apply_changes(change_stream(spark, feed), store, marks).awaitTermination()
    store.refresh()
    return _rows(store.objects, store.edges)


def minute_counts(spark, sf_dir):
    """Calls of each user in each minute, counted by a stream over all events."""
    source = _folder(spark)
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    events.write.parquet(source)
    stream = requests_per_minute(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source))
    found = run_to_end(stream, _folder(spark), _folder(spark))
    deleted(spark, source)
    return found


def documents_json(spark, sf_dir):
    """Objects written as JSON documents and read again, edges given as objects and as lists."""
    path = _folder(spark)
    objects, edges = _nations(spark, sf_dir)
    D.to_json(objects, full_edges(edges)).select("json").write.text(f"{path}/a")
    listed = _t(spark, sf_dir, "region").select(F.to_json(F.struct(_key("x", "r_regionkey").alias("id"), F.col("r_name").alias("text"), F.array(F.array(F.lit("related_to"), _key("r", "r_regionkey"))).alias("edges"))).alias("json"))
    listed.write.text(f"{path}/b")
    return _rows(*D.split_documents(D.read_documents(spark, f"{path}/*")))


def _named(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) of nations and regions under their names."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    objects = n.select(F.col("n_name").alias("id"), F.col("n_name").alias("content")).unionByName(r.select(F.col("r_name").alias("id"), F.col("r_name").alias("content")))
    edges = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.lit("part_of").alias("relation"), F.col("r_name").alias("dst"), F.lit(1.0).alias("weight"), F.col("n_nationkey").cast("long").alias("ord"))
    return objects, edges


def query_text(spark, sf_dir):
    """Questions in words, with one and with two names, by way of the whole engine; hops and k within a server's limits."""
    objects, edges = _named(spark, sf_dir)
    one = objects.select(F.concat(F.lit("a-"), "id").alias("qid"), F.concat(F.lit("what is part of "), "id", F.lit("?")).alias("text"))
    two = edges.select(F.concat(F.lit("b-"), "src").alias("qid"), F.concat(F.lit("is "), "src", F.lit(" connected to "), "dst", F.lit("?")).alias("text"))
    asked = clamped(one.unionByName(two).withColumn("k", F.lit(1_000_000)).withColumn("max_hops", F.lit(99)), 1_000_000)
    return query(asked, objects, edges, "graph", 5, VOCABULARY).select("qid", "object_id", "content", "score", "hops", "explain")


def query_target(spark, sf_dir):
    """The way from every supplier to every region, if there is one of two steps."""
    (a, b), (c, d) = _nations(spark, sf_dir), _suppliers(spark, sf_dir)
    regions = _t(spark, sf_dir, "region").select(_key("r", "r_regionkey").alias("target"))
    asked = c.select("id").join(regions, F.lit(True)).select(F.concat_ws(">", "id", "target").alias("qid"), F.col("id").alias("anchor"), "target", F.lit(2).alias("max_hops"))
    edges = b.unionByName(d).withColumn("ord", F.lit(0).cast("long"))
    return query(asked, a.unionByName(c), edges, "graph", 5, VOCABULARY).select("qid", "object_id", "rank", "score", "hops", F.array_join(F.transform("path", lambda p: p["relation"]), ">").alias("relations"), "explain")


def path_match(spark, sf_dir):
    """Measures of ``query_target`` against gold paths, of which those of odd suppliers are wrong."""
    found = query_target(spark, sf_dir).select("qid", "object_id", "rank", F.split("relations", ">").alias("relations"))
    s = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    odd = F.col("s_suppkey") % 2 == 1
    asked = s.select(F.concat_ws(">", _key("s", "s_suppkey"), _key("r", "n_regionkey")).alias("qid"), F.when(odd, "odd").otherwise("even").alias("kind"), F.array(_key("r", "n_regionkey")).alias("answers"), F.when(odd, F.array(F.lit("part_of"))).otherwise(F.array(F.lit("located_in"), F.lit("part_of"))).alias("gold_path"))
    return metrics.summarised(metrics.retrieval_metrics(found, asked, 5)).select("kind", "n", "hits_at_1", "reciprocal_rank", F.round("path_correct", 9).alias("path_correct"))


def demo_questions(spark, sf_dir):
    """Questions to the demo graphs, with the answers that they are known for."""
    asked = (("umbrella", "what prevents rain?"), ("umbrella", "is umbrella connected to wet_coat?"), ("pipe", "is pipe_120mm connected to steel_pipe?"), ("deps", "is checkout_api connected to CVE_2024_5001?"), ("deps", "is docs_portal connected to CVE_2024_5001?"))
    out = None
    for name in ("umbrella", "pipe", "deps"):
        objects, edges = D.demo(spark, name)
        own = spark.createDataFrame([(q, q) for d, q in asked if d == name], "qid string, text string")
        part = query(own, objects, edges, "graph").select(F.lit(name).alias("demo"), F.col("qid").alias("question"), "object_id", "hops", F.array_join(F.transform("path", lambda p: p["relation"]), ">").alias("relations"))
        out = part if out is None else out.unionByName(part)
    return out


def _examples(spark, sf_dir) -> DataFrame:
    """A question of two triples for every nation: nation, region, world; broken for nations with odd keys."""
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    triple = lambda s, r, o: F.struct(s.alias("s"), F.lit(r).alias("r"), o.alias("o"))
    second = F.when(F.col("n_nationkey") % 2 == 1, F.lit("elsewhere")).otherwise(F.col("r_name"))
    texts = F.array(F.struct(F.concat("n_name", F.lit(" (nation)")).alias("title"), F.concat("n_name", F.lit(" lies in "), "r_name").alias("text")), F.struct(F.col("r_name").alias("title"), F.concat(F.lit("of "), "n_name").alias("text")))
    return n.select(
        F.col("n_nationkey").alias("qid"), F.col("n_nationkey").alias("place"), F.lit("where?").alias("question"), F.lit("the world").alias("answer"), F.lit("t").alias("qtype"),
        F.array(triple(F.col("n_name"), "part of", F.col("r_name")), triple(second, "lies in", F.lit("the world"))).alias("evidences"), texts.alias("context"),
    )


def chains(spark, sf_dir):
    """Examples whose triples form one path."""
    return evaluate.chains(_examples(spark, sf_dir)).select("qid", "source", F.array_join("relations", ">").alias("relations"), "target")


def corruptions(spark, sf_dir):
    """Kinds of negatives of the chains, with how many fit and differ from the chain in the right part only."""
    own = evaluate.chains(_examples(spark, sf_dir))
    first = own.select("qid", F.col("source").alias("s"), F.col("relations").alias("r"), F.col("target").alias("t"))
    both = evaluate.corrupted(own).join(first, "qid")
    s, r, t = F.col("source") == F.col("s"), F.col("relations") == F.col("r"), F.col("target") == F.col("t")
    same = F.array_sort("relations") == F.array_sort("r")
    fits = F.when(F.col("kind") == "tail_swap", s & r & ~t).when(F.col("kind") == "source_swap", ~s & r & t).when(F.col("kind") == "shuffle", s & ~r & t & same).otherwise(s & ~same & t)
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(fits).alias("n_fit"))


def entity_texts(spark, sf_dir):
    """The longest text under any form of each entity's name, of equals the first."""
    return evaluate.entity_texts(_examples(spark, sf_dir))


def examples_graph(spark, sf_dir):
    """The graph of all examples' triples."""
    objects, edges = D.examples_graph(_examples(spark, sf_dir))
    return _rows(objects, edges)


def examples_study(spark, sf_dir):
    """Traversal from the head entity to the answer, against the gold paths."""
    out = evaluate.run_examples(_examples(spark, sf_dir), 1000, ("graph",))
    return out.where("retriever = 'engine-graph' and kind is null").select("n", "hits_at_k", F.round("path_correct", 9).alias("path_correct"), "link_correct")


def detours(spark, sf_dir):
    """Other ways of up to three steps from every supplier to its region: through a rival of its nation."""
    _, edges = D.driver_graph(spark, sf_dir)
    s = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = s.select(F.col("s_suppkey").alias("qid"), _key("s", "s_suppkey").alias("source"), F.array(F.lit("located_in"), F.lit("part_of")).alias("relations"), _key("r", "n_regionkey").alias("target"))
    return other_ways(own, edges, 3).select("qid", F.array_join("relations", ">").alias("relations"))


def parse_hook(spark, sf_dir):
    """A caller's own parser for every question about a nation, and the rules where it has no answer."""
    objects, _ = _named(spark, sf_dir)
    asked = objects.select(F.col("id").alias("qid"), F.concat(F.lit("what prevents "), "id", F.lit("?")).alias("text"))
    first = written(objects.select("id"), "ids")

    def parse(text: str):
        name = text.removeprefix("what prevents ").rstrip("?")
        return (name, "causes", None) if len(name) % 2 else ("nobody", "causes", None)

    return hooks.parse_with(asked, first, parse).select("qid", "anchor", "relation", "target")


def vocabulary(spark, sf_dir):
    """The built-in relations."""
    return Vocabulary().frame(spark).select("name", F.col("symmetric").alias("both_ways"), "transitive", "inverse")


_QUERIES = (
    store_replay, store_update, store_insert_text, store_scan, store_backup, store_parallel, store_signatures, change_feed, minute_counts, documents_json, query_text, query_target, path_match, demo_questions,
    chains, corruptions, entity_texts, examples_graph, examples_study, detours, parse_hook, vocabulary,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_BASE = """
WITH o AS (SELECT 'n:' || n_nationkey AS id, n_name AS content, n_nationkey AS k FROM nation UNION ALL SELECT 'r:' || r_regionkey, r_name, NULL FROM region),
p AS (SELECT 'n:' || n_nationkey AS src, 'part_of' AS relation, 'r:' || n_regionkey AS dst, 1.0::DOUBLE AS weight, n_nationkey AS k FROM nation),
l AS (SELECT 's:' || s_suppkey AS src, 'located_in' AS relation, 'n:' || s_nationkey AS dst, 1.0::DOUBLE AS weight, s_nationkey AS k, s_suppkey FROM supplier),
nr AS (SELECT n_nationkey AS k, n_name AS n, r_name AS r, n_regionkey AS rk FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_OBJECT = "src, '' AS relation, '' AS dst, 0.0::DOUBLE AS weight, content"
_EDGE = "src, relation, dst, weight, '' AS content"


def oracle_sql() -> dict[str, str]:
    from trailweave.queries import _NORMALISED, _triples_sql

    names = lambda c: _NORMALISED % c
    text = f"t AS (SELECT unnest([{names('n')}, {names("n || ' (nation)'")}]) AS id, n || ' lies in ' || r AS text, k, 0 AS place FROM nr UNION ALL SELECT {names('r')}, 'of ' || n, k, 1 FROM nr), longest AS (SELECT id, arg_min(text, (-length(text), k, place)) AS text FROM t GROUP BY id)"
    triples = f"tr AS (SELECT k, 0 AS place, {names('n')} AS s, 'part_of' AS rel, {names('r')} AS o FROM nr UNION ALL SELECT k, 1, CASE WHEN k % 2 = 1 THEN 'elsewhere' ELSE {names('r')} END, 'lies_in', 'the world' FROM nr)"
    return {
        "store_replay": f"{_BASE} SELECT id AS {_OBJECT} FROM (SELECT id, CASE WHEN k % 10 = 0 THEN 'again ' || content ELSE content END AS content FROM o WHERE k IS NULL OR k % 5 <> 0 OR k % 10 = 0 UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier) UNION ALL SELECT {_EDGE} FROM (SELECT src, relation, dst, weight FROM p WHERE k % 5 <> 0 UNION ALL SELECT src, relation, dst, weight FROM l WHERE k % 5 <> 0)",
        "store_update": f"{_BASE} SELECT id AS {_OBJECT} FROM (SELECT o.id, CASE WHEN n_regionkey = 0 THEN 'new ' || content ELSE content END AS content FROM o LEFT JOIN nation ON n_nationkey = k) UNION ALL SELECT {_EDGE} FROM (SELECT src, relation, dst, weight FROM p UNION ALL SELECT 'n:' || n_nationkey, 'related_to', 'r:1', 2.0 FROM nation WHERE n_regionkey = 0)",
        "store_insert_text": f"WITH {_triples_sql('documents', 'doc_id')}, own AS (SELECT DISTINCT subject, relation, object FROM triples WHERE subject <> '' AND object <> '') SELECT DISTINCT id AS src, '' AS relation, '' AS dst, 0.0::DOUBLE AS weight, id AS content FROM (SELECT subject AS id FROM own UNION ALL SELECT object FROM own) UNION ALL SELECT subject, relation, object, 1.0, '' FROM own",
        "store_scan": f"{_BASE} SELECT 'get' AS op, id, content AS value FROM o WHERE id = 'n:3' UNION ALL SELECT 'many', id, CASE id WHEN 'n:9' THEN '0' ELSE '2' END FROM o WHERE id IN ('n:9', 'n:2') UNION ALL SELECT 'out', dst, relation FROM p WHERE src = 'n:3' UNION ALL SELECT 'in', src, relation FROM p WHERE dst = 'r:1' UNION ALL SELECT DISTINCT 'dangling', dst, '' FROM p UNION ALL SELECT 'count', '', count(*)::VARCHAR FROM nation UNION ALL SELECT 'has', 'n:1', 'True' UNION ALL SELECT 'has', 'r:1', 'False'",
        "store_backup": f"{_BASE} SELECT 'part_of' AS relation, count(*) AS n, 'store' AS store FROM p UNION ALL SELECT 'part_of', count(*), 'restored' FROM p UNION ALL SELECT 'located_in', count(*), 'restored' FROM l",
        "store_parallel": f"{_BASE} SELECT 'multi' AS kind, src, dst, unnest([1.0::DOUBLE, 3.0]) AS weight FROM p UNION ALL SELECT 'durable', src, dst, 3.0 FROM p",
        "store_signatures": f"{_BASE}, left_ AS (SELECT src, dst FROM p WHERE k <> 0), own AS (SELECT src AS id, 2::BIGINT AS n_nodes FROM left_ UNION ALL SELECT dst, 1 + count(*) FROM left_ GROUP BY dst) SELECT id, n_nodes, (n_nodes - 1)::DOUBLE AS bars, (SELECT count(*) FROM o) AS first, (SELECT count(*) FROM p WHERE dst = (SELECT dst FROM p WHERE k = 0)) AS second, 0::BIGINT AS last FROM own",
        "change_feed": f"{_BASE} SELECT id AS {_OBJECT} FROM o WHERE substr(id, 3)::INT % 2 = 1 UNION ALL SELECT {_EDGE} FROM p WHERE k % 2 = 1 AND substr(dst, 3)::INT % 2 = 1",
        "minute_counts": "SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL",
        "documents_json": f"{_BASE} SELECT id AS {_OBJECT} FROM (SELECT id, content FROM o UNION ALL SELECT 'x:' || r_regionkey, r_name FROM region) UNION ALL SELECT {_EDGE} FROM p UNION ALL SELECT 'x:' || r_regionkey, 'related_to', 'r:' || r_regionkey, 1.0, '' FROM region",
        "query_text": f"{_BASE} SELECT 'a-' || r AS qid, n AS object_id, n AS content, 0.0::DOUBLE AS score, 1 AS hops, n || ' --[part_of]--> ' || r || '  (score=0.0000, hops=1)' AS explain FROM nr UNION ALL SELECT 'b-' || n, r, r, 0.5, 1, n || ' --[part_of]--> ' || r || '  (score=0.5000, hops=1)' FROM nr WHERE NOT EXISTS (SELECT 1 FROM nr AS b WHERE b.n <> nr.n AND contains(nr.n, b.n))",
        "query_target": f"{_BASE} SELECT l.src || '>' || p.dst AS qid, p.dst AS object_id, 1 AS rank, 1.0::DOUBLE AS score, 2 AS hops, 'located_in>part_of' AS relations, l.src || ' --[located_in]--> ' || l.dst || ' --[part_of]--> ' || p.dst || '  (score=1.0000, hops=2)' AS explain FROM l JOIN p ON l.dst = p.src",
        "path_match": "WITH s AS (SELECT CASE WHEN s_suppkey % 2 = 1 THEN 'odd' ELSE 'even' END AS kind, (s_suppkey % 2 = 0)::INT AS ok FROM supplier) SELECT kind, count(*) AS n, 1.0::DOUBLE AS hits_at_1, 1.0::DOUBLE AS reciprocal_rank, round(avg(ok), 9) AS path_correct FROM s GROUP BY GROUPING SETS ((), (kind))",
        "demo_questions": "SELECT * FROM (VALUES ('umbrella', 'what prevents rain?', 'umbrella', 1, 'prevents'), ('umbrella', 'is umbrella connected to wet_coat?', 'wet_coat', 2, 'prevents>causes'), ('pipe', 'is pipe_120mm connected to steel_pipe?', 'steel_pipe', 4, 'similar_to>compatible_with>requires>used_in'), ('deps', 'is checkout_api connected to CVE_2024_5001?', 'CVE_2024_5001', 3, 'depends_on>depends_on>affected_by')) AS t(demo, question, object_id, hops, relations)",
        "chains": f"{_BASE} SELECT k AS qid, {names('n')} AS source, 'part of>lies in' AS relations, 'the world' AS target FROM nr WHERE k % 2 = 0",
        "corruptions": "WITH c AS (SELECT count(*) AS n FROM nation WHERE n_nationkey % 2 = 0) SELECT kind, n, n AS n_fit FROM c CROSS JOIN (VALUES ('shuffle'), ('tail_swap'), ('source_swap')) AS k(kind)",
        "entity_texts": f"{_BASE}, {text}, names AS (SELECT n AS name FROM nr UNION ALL SELECT r FROM nr UNION ALL SELECT 'the world' UNION ALL SELECT 'elsewhere' FROM nr WHERE k % 2 = 1), named AS (SELECT {names('name')} AS id, min(name) AS name FROM names GROUP BY 1) SELECT coalesce(named.id, longest.id) AS id, coalesce(text, name) AS text, text IS NOT NULL AS from_paragraph FROM longest FULL JOIN named ON named.id = longest.id",
        "examples_graph": f"{_BASE}, {text.replace(f"unnest([{names('n')}, {names("n || ' (nation)'")}])", names("n || ' (nation)'"))}, {triples}, nodes AS (SELECT id FROM longest UNION SELECT s FROM tr UNION SELECT o FROM tr) SELECT id AS {_OBJECT} FROM (SELECT nodes.id, coalesce(text, nodes.id) AS content FROM nodes LEFT JOIN longest USING (id)) UNION ALL SELECT DISTINCT s, rel, o, 1.0::DOUBLE, '' FROM tr",
        "examples_study": "SELECT count(*) AS n, 1.0::DOUBLE AS hits_at_k, 1.0::DOUBLE AS path_correct, 1.0::DOUBLE AS link_correct FROM nation",
        "detours": f"{_BASE} SELECT DISTINCT s_suppkey AS qid, 'located_in>contradicts>part_of' AS relations FROM l JOIN nr a ON a.k = l.k JOIN nr b ON a.rk = b.rk AND a.k < b.k AND (a.k + b.k) % 2 = 1",
        "parse_hook": f"{_BASE}, i AS (SELECT content AS id FROM o) SELECT id AS qid, id AS anchor, CASE WHEN length(id) % 2 = 1 THEN 'causes' ELSE 'prevented_by' END AS relation, NULL::VARCHAR AS target FROM i",
        "vocabulary": "SELECT * FROM (VALUES ('causes', false, false, 'caused_by'), ('caused_by', false, false, 'causes'), ('prevents', false, false, 'prevented_by'), ('prevented_by', false, false, 'prevents'), ('requires', false, false, 'required_by'), ('required_by', false, false, 'requires'), ('is_a', false, true, 'subsumes'), ('subsumes', false, true, 'is_a'), ('part_of', false, true, 'has_part'), ('has_part', false, true, 'part_of'), ('example_of', false, false, 'has_example'), ('has_example', false, false, 'example_of'), ('conforms_to', false, false, 'specified_by'), ('specified_by', false, false, 'conforms_to'), ('used_in', false, false, 'uses'), ('uses', false, false, 'used_in'), ('contradicts', true, false, 'contradicts'), ('compatible_with', true, false, 'compatible_with'), ('similar_to', true, false, 'similar_to'), ('related_to', true, false, 'related_to')) AS t(name, both_ways, transitive, inverse)",
    }
