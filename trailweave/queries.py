"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave import stored
from trailweave.cluster import written
from trailweave.functions import text as X
from trailweave.functions import vectors as V
from trailweave.functions.vocabulary import Vocabulary
from trailweave.operators import extraction, metrics, onehop, retrieval, sheaf, topology
from trailweave.operators.rank import explained
from trailweave.operators.traversal import geodesic_paths
from trailweave.plans import evaluate
from trailweave.plans.query import blast_radius as reached_from
from trailweave.plans.query import graph_export as exported
from trailweave.plans.query import query
from trailweave.sources.documents import driver_graph, star_graph
from trailweave.sources.store import full_edges, merged_edges

VOCABULARY = Vocabulary().register("placed", inverse="placed_by").register("supplied_by", inverse="supplies").register("located_in", inverse="location_of")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _anchors(objects: DataFrame, kind: str, **more) -> DataFrame:
    own = objects.where(F.startswith("id", F.lit(f"{kind}:"))).select(F.col("id").alias("qid"), F.col("id").alias("anchor"))
    return own.withColumns({k: v if not isinstance(v, (str, int)) else F.lit(v) for k, v in more.items()})


def _unit(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.lit(1.0))


def direct_forward(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    out = onehop.direct(_anchors(objects, "p", relation="supplied_by"), edges, VOCABULARY)
    return out.join(objects.select(F.col("id").alias("object_id"), "content"), "object_id", "left").select("qid", "object_id", "score", "geodesic", F.coalesce("content", F.lit("")).alias("content"))


def direct_inverse(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    both = _anchors(objects, "p", relation="part_of").unionByName(_anchors(objects, "r", relation="has_part"))
    return onehop.direct(both, edges, VOCABULARY).select("qid", "object_id", "geodesic", F.get("path", F.lit(0))["source"].alias("source"), F.get("path", F.lit(0))["relation"].alias("relation"))


def contradictions(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    return onehop.contradictions(_anchors(objects, "n"), edges, VOCABULARY).select("qid", "object_id", "score", F.get("path", F.lit(0))["source"].alias("source"))


def neighbors(spark, sf_dir):
    _, edges = driver_graph(spark, sf_dir)
    return onehop.neighbors(edges, "supplied_by").select("src", F.size("targets").cast("long").alias("n"), F.array_join(F.array_sort("targets"), ",").alias("targets"))


def path_reach_khop(spark, sf_dir):
    objects, edges = star_graph(spark, sf_dir, merged=False)
    chain = F.array(*map(F.lit, ("placed", "has_part", "supplied_by", "located_in")))
    return geodesic_paths(_anchors(objects, "c", chain=chain, max_hops=4), _unit(edges), paths=False).select("qid", "object_id", "geodesic", "hops")


def path_chain(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    chain = F.array(F.lit("placed"), F.lit("has_part"))
    out = geodesic_paths(_anchors(objects, "c", chain=chain, max_hops=2), _unit(edges))
    return out.select("qid", "object_id", "hops", F.array_join(F.transform("path", lambda p: p["relation"]), ">").alias("relations"), F.element_at("path", -1)["source"].alias("via"))


def path_weighted(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    chain = F.array(*map(F.lit, ("supplied_by", "located_in", "part_of")))
    return geodesic_paths(_anchors(objects, "p", chain=chain, max_hops=3), edges, plan="rounds").select("qid", "object_id", "geodesic", "hops")


def path_cheapest(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    return geodesic_paths(_anchors(objects, "p", max_hops=2), edges, plan="min").select("qid", "object_id", "geodesic", "hops")


def blast_radius(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    return reached_from(objects.where("startswith(id, 'c:')"), "n:0", edges.where("relation <> 'contradicts'"), 4)


def explain_paths(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    out = geodesic_paths(_anchors(objects, "s", max_hops=2), _unit(edges))
    score = 0.5 * F.col("geodesic")
    return out.select("qid", "object_id", explained(F.col("path"), score, F.col("hops")).alias("explain"))


def rank_graph(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    return query(_anchors(objects, "s", max_hops=2), objects, _unit(edges), "graph", 5, VOCABULARY).select("qid", "rank", "object_id", "content", "score", "hops")


def query_relation(spark, sf_dir):
    """All suppliers of each nation, by the virtual inverse of their edge to it."""
    objects, edges = driver_graph(spark, sf_dir)
    return query(_anchors(objects, "n", relation="location_of"), objects, edges, "graph", 1_000_000, VOCABULARY).select("qid", "object_id", "content", "score", "geodesic", "explain")


def graph_export(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    return exported(objects.where("not startswith(id, 'r:')"), edges)


def upsert_edges(spark, sf_dir):
    """Every nation is put again with one edge to the region of the next number."""
    objects, edges = driver_graph(spark, sf_dir)
    n = _t(spark, sf_dir, "nation")
    new = full_edges(n.select(F.concat(F.lit("n:"), "n_nationkey").alias("src"), F.lit("part_of").alias("relation"), F.concat(F.lit("r:"), ((F.col("n_regionkey") + 1) % 5)).alias("dst"), F.lit(2.0).alias("weight")))
    return merged_edges(full_edges(edges), new.select(F.col("src").alias("id")), new).groupBy("relation", "weight").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def delete_cascade(spark, sf_dir):
    """All suppliers of nations in region 0 go, with every edge from or to them."""
    objects, edges = driver_graph(spark, sf_dir)
    gone = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation").where("n_regionkey = 0"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s:"), "s_suppkey").alias("id"))
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    rest = objects.join(gone, "id", "left_anti")
    counts = left.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(rest.agg(F.lit("objects").alias("relation"), F.count(F.lit(1)).alias("n")))


def extract_triples(spark, sf_dir):
    return extraction.extract_triples(_t(spark, sf_dir, "documents")).select("doc_id", "subject", "relation", "object", "weight")


def extract_triples_chat(spark, sf_dir):
    return extraction.registered(extraction.extract_triples(_t(spark, sf_dir, "conversations"), "conv_id")).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("subject")).alias("subject_chars"), F.sum(F.length("object")).alias("object_chars"))


def _names(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "nation").select(F.col("n_name").alias("id")).unionByName(_t(spark, sf_dir, "region").select(F.col("r_name").alias("id")))


def _questions(spark, sf_dir) -> DataFrame:
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = n.select(F.concat(F.lit("a"), "n_nationkey").alias("qid"), F.concat(F.lit("what prevents "), "n_name", F.lit("?")).alias("text"))
    two = n.select(F.concat(F.lit("b"), "n_nationkey").alias("qid"), F.concat(F.lit("is "), "n_name", F.lit(" part of "), "r_name", F.lit("?")).alias("text"))
    return one.unionByName(two)


def intent_parse(spark, sf_dir):
    return extraction.parse_intents(_questions(spark, sf_dir), _names(spark, sf_dir)).select("qid", "anchor", "relation", "target")


def surface_link(spark, sf_dir):
    names = _names(spark, sf_dir).select(X.normalised(F.col("id")).alias("name"))
    return retrieval.surface_link(_questions(spark, sf_dir), names, 3)


def tfidf_topk(spark, sf_dir):
    docs, items = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.tfidf(items, docs, 5)


def bm25_topk(spark, sf_dir):
    docs, items = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.bm25(items, docs, 10)


def text_functions(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", X.normalised(F.col("c_name")).alias("normalised"), X.slug(F.col("c_mktsegment")).alias("slug"), F.size(X.tokens(F.col("c_name"))).cast("long").alias("n_tokens"), X.without_articles(F.concat(F.lit("The "), "c_name")).alias("bare"))


def term_statistics(spark, sf_dir):
    posted = retrieval.postings(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return e.where("id % 100 = 0").withColumnRenamed("id", "qid"), e


def similar_exact_topk(spark, sf_dir):
    asked, entries = _vectors(spark, sf_dir)
    return topology.exact_top(asked, entries, 5).select("qid", "id", "rank", F.round("similarity", 6).alias("similarity"))


#: Planes of the sketches, the differing bits that are ranked, their seed.
SKETCH = (256, 112, 0)


def lsh_codes(spark, sf_dir):
    """Sign codes of all vectors for 16 planes."""
    _, entries = _vectors(spark, sf_dir)
    return entries.select("id", V.sign_code(V.unit(F.col("vector")), V.sign_planes(16, 64)).alias("code"))


def lsh_topk(spark, sf_dir):
    """The nearest by sketches, of the vectors whose id is divisible by 100."""
    asked, entries = _vectors(spark, sf_dir)
    return topology.sketch_top(asked, entries, 5, *SKETCH).select("qid", "id", "rank", F.round("similarity", 6).alias("similarity"))


def lsh_recall(spark, sf_dir):
    """Recall of the sketches against all vectors, and the share of vectors that they rank."""
    asked, entries = _vectors(spark, sf_dir)
    found = written(topology.sketch_top(asked, entries, 5, *SKETCH), "found")
    share = found.where("rank = 1").agg((F.sum("ranked") / F.count(F.lit(1))).alias("ranked")).withColumn("ranked", F.round(F.col("ranked") / entries.agg(F.count(F.lit(1))).scalar(), 9))
    return topology.recall(topology.exact_top(asked, entries, 5), found).withColumn("recall", F.round("recall", 9)).withColumn("ranked_share", share.scalar())


def ir_metrics(spark, sf_dir):
    """BM25 of each benchmark item over documents, judged by documents of the same words at rank 1 of TF-IDF."""
    found = bm25_topk(spark, sf_dir).select("qid", F.col("id").alias("object_id"), "rank")
    best = tfidf_topk(spark, sf_dir).where("rank = 1").select("qid", F.array("id").alias("answers"))
    asked = best.select("qid", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd").alias("kind"), "answers", F.lit(None).cast("array<string>").alias("gold_path"))
    return metrics.summarised(metrics.retrieval_metrics(found, asked, 5)).select("kind", "n", F.round("hits_at_1", 9).alias("hits_at_1"), F.round("hits_at_k", 9).alias("hits_at_k"), F.round("precision_at_k", 9).alias("precision_at_k"), F.round("recall_at_k", 9).alias("recall_at_k"), F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


def auc(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("positive"))
    return metrics.auc(rows).select(F.round("auc", 9).alias("auc"))


def nearest_rank_percentile(spark, sf_dir):
    return metrics.nearest_rank(_t(spark, sf_dir, "events"), "value", [50, 95, 99], ["event_type"])


def win_rate(spark, sf_dir):
    return metrics.win_rate(_t(spark, sf_dir, "lineitem"), "l_discount", "l_tax", ["l_returnflag"])


def rate_limit(spark, sf_dir):
    return metrics.rate_limited(_t(spark, sf_dir, "events"), 1).select("event_id", "user_id", "allowed", "retry_after")


def http_metrics(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return metrics.request_metrics(rows, "event_type", "ok", "value").withColumn("mean_latency", F.round("mean_latency", 6))


def extraction_study(spark, sf_dir):
    out = evaluate.run_extraction(spark)
    return out.select("n_predicted", "n_gold", "n_exact", *[F.round(c, 3).alias(c) for c in ("precision", "recall", "f1", "relation_accuracy")])


def sheaf_rank(spark, sf_dir):
    objects, edges = driver_graph(spark, sf_dir)
    return query(_anchors(objects, "s", max_hops=2), objects, _unit(edges), "sheaf", 5, VOCABULARY).select("qid", "rank", "object_id", F.round("score", 9).alias("score"))


def topo_signature(spark, sf_dir):
    """Signatures of all objects from what lies one step around them."""
    objects, edges = driver_graph(spark, sf_dir)
    out = topology.signatures(objects, edges, 1)
    bins = F.transform("topo_signature", lambda x: x.cast("int").cast("string"))
    return out.select("id", "n_nodes", F.array_join(F.slice(bins, 1, 32), ",").alias("h0"), F.aggregate(F.slice("topo_signature", 33, 32), F.lit(0.0), lambda a, x: a + x).alias("loops"))


def _stalks(spark, sf_dir):
    """Every vector as the stalk of the supplier, nation and region of its number."""
    own = _t(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("sheaf_stalk"))
    return own.select(F.explode(F.array(*[F.concat(F.lit(k), F.col("vec_id").cast("string")) for k in ("s:", "n:", "r:")])).alias("id"), "sheaf_stalk")


def procrustes(spark, sf_dir):
    """Maps learned from the embeddings of neighbours: suppliers, nations and regions take the vectors of their numbers."""
    _, edges = driver_graph(spark, sf_dir)
    maps = sheaf.learned_maps(edges, _stalks(spark, sf_dir), VOCABULARY)
    return spark.createDataFrame([(r, i, j, float(round(m[i, j], 6))) for r, m in sorted(maps.items()) for i in range(len(m)) for j in range(len(m))], "relation string, i int, j int, value double")


def stalk_moments(spark, sf_dir):
    """The sums that maps are learned from."""
    _, edges = driver_graph(spark, sf_dir)
    return sheaf.moments(edges, _stalks(spark, sf_dir)).select("relation", "i", "j", F.round("m", 6).alias("m"))


def sheaf_residual(spark, sf_dir):
    """How far identity maps miss along every edge whose ends have vectors, and their mean for each relation."""
    _, edges = driver_graph(spark, sf_dir)
    stalks = _stalks(spark, sf_dir)
    known = stalks.select("id")
    own = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    step = F.array(F.struct(F.col("src").alias("source"), "relation", F.col("dst").alias("target"), "weight"))
    rows = own.select(F.col("src").alias("anchor"), F.col("dst").alias("object_id"), "relation", step.alias("path"))
    identity = {r: np.eye(64) for r in ("located_in", "part_of", "contradicts")}
    return sheaf.residuals(rows, 64, stalks, VOCABULARY, identity).select(F.col("anchor").alias("src"), F.col("object_id").alias("dst"), "relation", F.round("sheaf", 6).alias("residual"))


def learned_maps_study(spark, sf_dir):
    return evaluate.run_learned_maps(spark).withColumn("residual", F.round("residual", 6))


def worlds_study(spark, sf_dir):
    """The published comparison: 40 worlds by seed 0, all measures over all questions."""
    out = evaluate.run_worlds(spark).where("kind is null")
    return out.select("retriever", "n", *[F.round(c, 3).alias(c) for c in ("hits_at_1", "hits_at_k", "precision_at_k", "recall_at_k", "reciprocal_rank", "path_correct")])


def alias_keys(spark, sf_dir):
    """Names of parts with a qualifier, as titles may have one."""
    title = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(X.alias_keys(title), "|").alias("keys"))


def random_floor(spark, sf_dir):
    """Five documents for each benchmark item in a seeded order."""
    docs, items = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    found = retrieval.random_top(items, docs, 5).join(docs, "id", "left_semi")
    return found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_distinct"), F.max("rank").alias("last"))


def bm25_link(spark, sf_dir):
    """The document that BM25 links each benchmark item to."""
    return bm25_topk(spark, sf_dir).where("rank = 1").select("qid", "id")


def projected_accuracy(spark, sf_dir):
    """What the extraction recall leaves of paths of one to four hops."""
    recall = evaluate.run_extraction(spark).first().recall
    return metrics.projected_accuracy(spark, recall, 4).select("hops", F.round("accuracy", 3).alias("accuracy"))


_QUERIES = (
    direct_forward, direct_inverse, contradictions, neighbors, path_reach_khop, path_chain, path_weighted, path_cheapest, blast_radius, explain_paths, rank_graph, query_relation,
    graph_export, upsert_edges, delete_cascade, extract_triples, extract_triples_chat, intent_parse, surface_link, tfidf_topk, bm25_topk, text_functions, term_statistics,
    similar_exact_topk, lsh_codes, lsh_topk, lsh_recall, ir_metrics, auc, nearest_rank_percentile, win_rate, rate_limit, http_metrics, extraction_study, sheaf_rank, topo_signature, procrustes,
    stalk_moments, sheaf_residual, learned_maps_study, worlds_study, alias_keys, random_floor, bm25_link, projected_accuracy,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES} | stored.queries()


_GRAPH = """
WITH e AS (
  SELECT 'c:' || o_custkey AS src, 'placed' AS relation, 'o:' || o_orderkey AS dst, 1.0::DOUBLE AS weight FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'has_part', 'p:' || l_partkey, min(l_linenumber)::DOUBLE FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'p:' || l_partkey, 'supplied_by', 's:' || l_suppkey, min(l_linenumber)::DOUBLE FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 's:' || s_suppkey, 'located_in', 'n:' || s_nationkey, 1.0 FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'part_of', 'r:' || n_regionkey, 1.0 FROM nation
  UNION ALL SELECT 'n:' || a.n_nationkey, 'contradicts', 'n:' || b.n_nationkey, 1.0 FROM nation a JOIN nation b
    ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND (a.n_nationkey + b.n_nationkey) % 2 = 1
), x AS (
  SELECT 'c:' || c_custkey AS id, c_name AS content FROM customer UNION ALL SELECT 'p:' || p_partkey, p_name FROM part
  UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'n:' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, r_name FROM region UNION ALL SELECT 'o:' || o_orderkey, o_orderpriority FROM orders
)"""

_TOKENS = "regexp_extract_all(lower(%s), '[a-z0-9]+')"
_NORMALISED = "replace(trim(regexp_replace(lower(%s), '[^a-z0-9 ]+', ' ', 'g'), ' '), '  ', ' ')"
_POSTED = f"""
d AS (SELECT doc_id AS id, {_TOKENS % 'text'} AS toks FROM documents),
posted AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM d) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_TOKENS % 'text'}) AS term FROM benchmark) GROUP BY ALL)"""
_TFIDF = f"""{_POSTED},
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM dfs),
w AS (SELECT id, term, tf * idf AS w FROM posted JOIN idf USING (term)), norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
q AS (SELECT qid, term, qtf * idf AS qw FROM asked JOIN idf USING (term)), qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qnorm FROM q GROUP BY qid),
tfidf AS (
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT b.item_id AS qid, doc_id AS id, coalesce(round(dot / (norm * qnorm), 9), 0.0) AS score FROM benchmark b CROSS JOIN documents
    LEFT JOIN (SELECT qid, id, sum(qw * w) AS dot FROM q JOIN w USING (term) GROUP BY ALL) s ON s.qid = b.item_id AND s.id = doc_id
    LEFT JOIN norms n ON n.id = doc_id LEFT JOIN qn ON qn.qid = b.item_id)
)"""
_BM25 = """
m AS (SELECT count(*) AS n, avg(coalesce(len(toks), 0)) AS mean FROM d),
bm AS (
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
    SELECT qid, posted.id, round(sum(qtf * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / mean))), 9) AS score
    FROM asked JOIN dfs USING (term) JOIN posted USING (term) JOIN d ON d.id = posted.id CROSS JOIN m GROUP BY ALL)
)"""
_STRIP = "trim(%s, ' ,')"


def _triples_sql(table: str, id: str) -> str:
    words = extraction.KEYWORDS
    pick = " ".join(f"WHEN instr(l, '{w}') > 0 THEN {k}" for k, (w, _) in enumerate(words))
    names = ", ".join(f"({k}, '{w}', '{r}')" for k, (w, r) in enumerate(words))
    return f"""kw(k, word, relation) AS (VALUES {names}),
sent AS (SELECT {id} AS id, unnest(regexp_split_to_array(text, '[.\\n;]')) AS s FROM {table}),
hit AS (SELECT id, s, lower(s) AS l, CASE {pick.replace('instr(l,', 'instr(lower(s),')} END AS k FROM sent),
cut AS (SELECT id, relation, substr(s, 1, instr(l, word) - 1) AS a, substr(s, instr(l, word) + length(word)) AS b FROM hit JOIN kw USING (k)),
triples AS (SELECT id, {_STRIP % 'a'} AS subject, relation, {_STRIP % "regexp_replace(b, '^[[:alpha:]\\p{L}]*', '')"} AS object FROM cut)"""


_QUESTIONS = """
qs AS (SELECT 'a' || n_nationkey AS qid, 'what prevents ' || n_name || '?' AS text FROM nation
       UNION ALL SELECT 'b' || n_nationkey, 'is ' || n_name || ' part of ' || r_name || '?' FROM nation JOIN region ON n_regionkey = r_regionkey),
names AS (SELECT n_name AS id FROM nation UNION ALL SELECT r_name FROM region)"""


_VECTORS = """
stalks AS (SELECT k || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings CROSS JOIN (VALUES ('s:'), ('n:'), ('r:')) AS kinds(k)),
cells AS (SELECT id, unnest(range(len(e))) AS j, unnest(e) AS v FROM stalks)"""
_SKETCHES = """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
planes AS (SELECT p, list(CASE WHEN md5('0:' || p || ':' || k)[1] < '8' THEN 1.0 ELSE -1.0 END ORDER BY k) AS w FROM (SELECT unnest(range(%d)) AS p) CROSS JOIN (SELECT unnest(range(64)) AS k) GROUP BY p),
bits AS (SELECT id, p, (list_dot_product(e, w) >= 0)::INT AS bit FROM v CROSS JOIN planes)"""
_TOP = "row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM (SELECT a.id AS qid, b.id, round(exp(-list_distance(list_transform(a.e, lambda x: x / a.n), list_transform(b.e, lambda x: x / b.n))), 9) AS s"
_NEAR_BY = f"near_by AS (SELECT a.id AS qid, b.id FROM bits a JOIN bits b USING (p) WHERE a.id % 100 = 0 GROUP BY ALL HAVING sum((a.bit <> b.bit)::INT) <= {SKETCH[1]}), ranked AS (SELECT qid, id, s, {_TOP} FROM near_by m JOIN v a ON a.id = m.qid JOIN v b ON b.id = m.id))"
_EXACT = f"exact AS (SELECT qid, id, s, {_TOP} FROM v a CROSS JOIN v b WHERE a.id % 100 = 0))"


def oracle_sql() -> dict[str, str]:
    g, rank5 = _GRAPH, "row_number() OVER (PARTITION BY qid ORDER BY score, object_id)"
    two = "SELECT src AS qid, dst AS object_id, 1 AS hops, relation, src, dst, '' AS r2, '' AS d2 FROM e WHERE src LIKE 's:%' UNION ALL SELECT a.src, b.dst, 2, a.relation, a.src, a.dst, b.relation, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 's:%'"
    return {
        "direct_forward": f"{g} SELECT src AS qid, dst AS object_id, 0.0::DOUBLE AS score, weight AS geodesic, coalesce(content, '') AS content FROM e LEFT JOIN x ON id = dst WHERE relation = 'supplied_by'",
        "direct_inverse": f"{g} SELECT dst AS qid, src AS object_id, weight AS geodesic, src AS source, relation FROM e WHERE relation = 'has_part' OR relation = 'part_of'",
        "contradictions": f"{g} SELECT src AS qid, dst AS object_id, weight AS score, src AS source FROM e WHERE relation = 'contradicts' UNION ALL SELECT dst, src, weight, src FROM e WHERE relation = 'contradicts'",
        "neighbors": f"{g} SELECT src, count(*) AS n, string_agg(dst, ',' ORDER BY dst) AS targets FROM e WHERE relation = 'supplied_by' GROUP BY src",
        "path_reach_khop": f"{g}, h1 AS (SELECT src AS qid, dst FROM e WHERE relation = 'placed'), h2 AS (SELECT DISTINCT qid, e.dst FROM h1 JOIN e ON h1.dst = src AND relation = 'has_part'), h3 AS (SELECT DISTINCT qid, e.dst FROM h2 JOIN e ON h2.dst = src AND relation = 'supplied_by'), h4 AS (SELECT DISTINCT qid, e.dst FROM h3 JOIN e ON h3.dst = src AND relation = 'located_in') SELECT qid, dst AS object_id, h::DOUBLE AS geodesic, h AS hops FROM (SELECT *, 1 AS h FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3 UNION ALL SELECT *, 4 FROM h4)",
        "path_chain": f"{g} SELECT src AS qid, dst AS object_id, 1 AS hops, 'placed' AS relations, src AS via FROM e WHERE relation = 'placed' UNION ALL SELECT a.src, b.dst, 2, 'placed>has_part', min(b.src) FROM e a JOIN e b ON a.dst = b.src WHERE a.relation = 'placed' AND b.relation = 'has_part' GROUP BY a.src, b.dst",
        "path_weighted": f"{g}, h1 AS (SELECT src AS qid, dst, weight AS w FROM e WHERE relation = 'supplied_by'), h2 AS (SELECT qid, e.dst, min(w + weight) AS w FROM h1 JOIN e ON h1.dst = src AND relation = 'located_in' GROUP BY ALL), h3 AS (SELECT qid, e.dst, min(w + weight) AS w FROM h2 JOIN e ON h2.dst = src AND relation = 'part_of' GROUP BY ALL) SELECT qid, dst AS object_id, w AS geodesic, h AS hops FROM (SELECT *, 1 AS h FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3)",
        "path_cheapest": f"{g} SELECT src AS qid, dst AS object_id, weight AS geodesic, 1 AS hops FROM e WHERE src LIKE 'p:%' UNION ALL SELECT a.src, b.dst, min(a.weight + b.weight), 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'p:%' GROUP BY a.src, b.dst",
        "blast_radius": f"{g} SELECT DISTINCT a.src AS id, 4 AS hops FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src JOIN e d ON c.dst = d.src WHERE a.relation = 'placed' AND d.dst = 'n:0'",
        "explain_paths": f"{g}, two AS ({two}) SELECT qid, object_id, src || ' --[' || relation || ']--> ' || dst || CASE WHEN hops = 2 THEN ' --[' || r2 || ']--> ' || d2 ELSE '' END || '  (score=' || printf('%.4f', hops * 0.5) || ', hops=' || hops || ')' AS explain FROM two",
        "rank_graph": f"{g}, two AS ({two}) SELECT qid, rank, object_id, content, score, hops FROM (SELECT *, {rank5} AS rank FROM (SELECT qid, object_id, coalesce(content, '') AS content, (hops * 0.5)::DOUBLE AS score, hops FROM two LEFT JOIN x ON id = object_id)) WHERE rank <= 5",
        "query_relation": f"{g} SELECT dst AS qid, src AS object_id, content, 0.0::DOUBLE AS score, weight AS geodesic, src || ' --[located_in]--> ' || dst || '  (score=0.0000, hops=1)' AS explain FROM e JOIN x ON id = src WHERE relation = 'located_in'",
        "graph_export": f"{g} SELECT id, content, false AS dangling FROM x WHERE id NOT LIKE 'r:%' UNION ALL SELECT DISTINCT dst, dst, true FROM e WHERE dst LIKE 'r:%'",
        "upsert_edges": f"{g} SELECT relation, weight, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM (SELECT src, relation, dst, weight FROM e WHERE src NOT LIKE 'n:%' UNION ALL SELECT 'n:' || n_nationkey, 'part_of', 'r:' || ((n_regionkey + 1) % 5), 2.0 FROM nation) GROUP BY relation, weight",
        "delete_cascade": f"{g}, gone AS (SELECT 's:' || s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0) SELECT relation, count(*) AS n FROM e WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone) GROUP BY relation UNION ALL SELECT 'objects', count(*) FROM x WHERE id NOT IN (FROM gone)",
        "extract_triples": f"WITH {_triples_sql('documents', 'doc_id')} SELECT id AS doc_id, subject, relation, object, 1.0::DOUBLE AS weight FROM triples WHERE subject <> '' AND object <> ''",
        "extract_triples_chat": f"WITH {_triples_sql('conversations', 'conv_id')} SELECT relation, count(*) AS n, sum(length(subject))::BIGINT AS subject_chars, sum(length(object))::BIGINT AS object_chars FROM triples WHERE subject <> '' AND object <> '' GROUP BY relation",
        "intent_parse": f"WITH {_QUESTIONS}, found AS (SELECT qid, id, instr(lower(text), lower(id)) AS place, row_number() OVER (PARTITION BY qid ORDER BY instr(lower(text), lower(id)), length(id) DESC, id) AS n FROM qs JOIN names ON instr(lower(text), lower(id)) > 0) SELECT qid, max(CASE WHEN n = 1 THEN id END) AS anchor, CASE WHEN text LIKE 'what%' THEN CASE WHEN max(n) = 1 THEN 'prevented_by' ELSE 'prevents' END ELSE CASE WHEN max(n) = 1 AND min(place) > instr(lower(text), 'part of') THEN 'has_part' ELSE 'part_of' END END AS relation, max(CASE WHEN n = 2 THEN id END) AS target FROM qs LEFT JOIN found USING (qid) GROUP BY qid, text",
        "surface_link": f"WITH {_QUESTIONS}, nm AS (SELECT DISTINCT {_NORMALISED % 'id'} AS name FROM names), nt AS (SELECT name, len(list_distinct({_TOKENS % 'name'})) AS size, unnest(list_distinct({_TOKENS % 'name'})) AS term FROM nm), idf AS (SELECT term, ln((SELECT count(*) FROM nm) / (1 + count(*))) + 1 AS idf FROM nt GROUP BY term), q AS (SELECT qid, {_NORMALISED % 'text'} AS q FROM qs), qt AS (SELECT qid, unnest(list_distinct({_TOKENS % 'q'})) AS term FROM q), s AS (SELECT qid, name, round(sum(idf) * CASE WHEN count(*) = size THEN 2 ELSE 1 END * CASE WHEN contains(' ' || q || ' ', ' ' || name || ' ') THEN 1.5 ELSE 1 END + 0.01 * count(*), 9) AS score FROM qt JOIN nt USING (term) JOIN idf USING (term) JOIN q USING (qid) GROUP BY qid, name, size, q) SELECT qid, name, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name DESC) AS rank FROM s) WHERE rank <= 3",
        "tfidf_topk": f"WITH {_TFIDF} SELECT qid, id, score, rank FROM tfidf WHERE rank <= 5",
        "bm25_topk": f"WITH {_POSTED}, {_BM25} SELECT qid, id, score, rank FROM bm WHERE rank <= 10",
        "ir_metrics": f"WITH {_TFIDF}, {_BM25}, r AS (SELECT t.qid, CASE WHEN t.qid % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, min(b.rank) AS first FROM tfidf t LEFT JOIN bm b ON b.qid = t.qid AND b.id = t.id AND b.rank <= 10 WHERE t.rank = 1 GROUP BY ALL) SELECT kind, count(*) AS n, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END), 9) AS hits_at_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 9) AS hits_at_k, round(avg(CASE WHEN first <= 5 THEN 0.2 ELSE 0 END)::DOUBLE, 9) AS precision_at_k, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 9) AS recall_at_k, round(avg(coalesce(1.0 / first, 0)), 9) AS reciprocal_rank FROM r GROUP BY GROUPING SETS ((), (kind))",
        "text_functions": f"SELECT c_custkey, {_NORMALISED % 'c_name'} AS normalised, regexp_replace(lower(trim(c_mktsegment)), '\\s+', '_', 'g') AS slug, len({_TOKENS % 'c_name'}) AS n_tokens, array_to_string(list_filter({_TOKENS % "('The ' || c_name)"}, lambda t: t NOT IN ('the', 'a', 'an')), ' ') AS bare FROM customer",
        "term_statistics": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS % 'text'}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
        "similar_exact_topk": "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings), s AS (SELECT a.id AS qid, b.id, round(exp(-list_distance(list_transform(a.e, lambda x: x / a.n), list_transform(b.e, lambda x: x / b.n))), 9) AS s FROM v a CROSS JOIN v b WHERE a.id % 100 = 0) SELECT qid, id, rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s) WHERE rank <= 5",
        "auc": "WITH c AS (SELECT l_discount AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS m FROM lineitem GROUP BY 1), r AS (SELECT *, coalesce(sum(p) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(m * (below + p / 2)) / (sum(p) * sum(m)), 9) AS auc FROM r",
        "nearest_rank_percentile": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), p(percent) AS (VALUES (50.0::DOUBLE), (95.0), (99.0)) SELECT event_type, percent, value FROM r CROSS JOIN p WHERE k = greatest(1, least(n, round_even(percent / 100 * n, 0)))",
        "win_rate": "SELECT l_returnflag, count(*) AS n, avg((l_discount < l_tax)::INT::DOUBLE) AS win_rate, median(l_discount) AS median_gold, median(l_tax) AS median_other FROM lineitem GROUP BY 1",
        "rate_limit": "SELECT event_id, user_id, k <= 1 AS allowed, CASE WHEN k <= 1 THEN 0 ELSE (60 - epoch(ts)::BIGINT % 60) END::INT AS retry_after FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS k FROM events)",
        "http_metrics": "SELECT event_type, event_type <> 'error' AS ok, count(*) AS n, round(avg(value), 6) AS mean_latency FROM events GROUP BY 1, 2",
        "extraction_study": "SELECT 13::BIGINT AS n_predicted, 18::BIGINT AS n_gold, 8::BIGINT AS n_exact, 0.615::DOUBLE AS precision, 0.444::DOUBLE AS recall, 0.516::DOUBLE AS f1, 1.0::DOUBLE AS relation_accuracy",
        "lsh_codes": f"{_SKETCHES % 16} SELECT id, sum(bit << (15 - p))::BIGINT AS code FROM bits GROUP BY id",
        "lsh_topk": f"{_SKETCHES % SKETCH[0]}, {_NEAR_BY} SELECT qid, id, rank, round(s, 6) AS similarity FROM ranked WHERE rank <= 5",
        "lsh_recall": f"{_SKETCHES % SKETCH[0]}, {_NEAR_BY}, {_EXACT} SELECT count(*) AS n, count(r.id) AS found, round(count(r.id) / count(*), 9) AS recall, (SELECT round(count(*) / (SELECT count(DISTINCT qid) FROM exact) / (SELECT count(*) FROM embeddings), 9) FROM ranked) AS ranked_share FROM exact e LEFT JOIN ranked r ON r.qid = e.qid AND r.id = e.id AND r.rank <= 5 WHERE e.rank <= 5",
        "topo_signature": f"{g}, both_ways AS (SELECT src AS id, dst AS o, weight FROM e UNION ALL SELECT dst, src, weight FROM e), near AS (SELECT id, o, min(weight) AS w FROM both_ways GROUP BY ALL), top AS (SELECT id, count(*) AS n, max(w) AS most FROM near GROUP BY id), b AS (SELECT id, least(31, floor(w / most * 32))::INT AS bin, count(*) AS c FROM near JOIN top USING (id) GROUP BY ALL) SELECT top.id, n + 1 AS n_nodes, string_agg(coalesce(c, 0)::VARCHAR, ',' ORDER BY r.bin) AS h0, 0.0::DOUBLE AS loops FROM top CROSS JOIN (SELECT unnest(range(32)) AS bin) r LEFT JOIN b ON b.id = top.id AND b.bin = r.bin GROUP BY top.id, n",
        "stalk_moments": f"{g}, {_VECTORS} SELECT relation, i::INT AS i, j::INT AS j, round(sum(b.v * a.v), 6) AS m FROM e JOIN cells a ON a.id = src JOIN (SELECT id, j AS i, v FROM cells) b ON b.id = dst GROUP BY relation, i, j",
        "sheaf_residual": f"{g}, {_VECTORS} SELECT src, dst, relation, round(list_distance(a.e, b.e) / sqrt(list_sum(list_transform(b.e, lambda x: x * x))), 6) AS residual FROM e JOIN stalks a ON a.id = src JOIN stalks b ON b.id = dst",
        "worlds_study": "SELECT * FROM (VALUES ('random', 160::BIGINT, 0.006::DOUBLE, 0.019::DOUBLE, 0.004::DOUBLE, 0.019::DOUBLE, 0.010::DOUBLE, 0.0::DOUBLE), ('lexical', 160, 0.25, 0.75, 0.15, 0.75, 0.375, 0.0), ('engine-graph', 160, 1, 1, 0.2, 1, 1, 1), ('engine-topo', 160, 1, 1, 0.2, 1, 1, 1), ('engine-sheaf', 160, 1, 1, 0.2, 1, 1, 1), ('engine-reasoning', 160, 1, 1, 0.2, 1, 1, 1)) AS t(retriever, n, hits_at_1, hits_at_k, precision_at_k, recall_at_k, reciprocal_rank, path_correct)",
        "alias_keys": f"SELECT p_partkey, {_NORMALISED % "(p_name || ' (' || p_brand || ')')"} || '|' || {_NORMALISED % 'p_name'} AS keys FROM part",
        "random_floor": "SELECT item_id AS qid, 5::BIGINT AS n, 5::BIGINT AS n_distinct, 5 AS last FROM benchmark",
        "bm25_link": f"WITH {_POSTED}, {_BM25} SELECT qid, id FROM bm WHERE rank = 1",
        "projected_accuracy": "SELECT h AS hops, round(pow(8 / 18, h), 3) AS accuracy FROM (SELECT unnest(range(1, 5)) AS h)",
    } | stored.oracle_sql()
