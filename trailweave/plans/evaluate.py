"""Evaluation runs: worlds, multi-hop questions, extraction, learned maps, chain corruption, reports."""

from __future__ import annotations

import json
import time

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.cluster import written
from trailweave.functions.text import alias_keys, normalised, slug
from trailweave.functions.vocabulary import Vocabulary
from trailweave.operators import metrics, retrieval
from trailweave.operators.extraction import extract_triples
from trailweave.operators.ranges import numbered
from trailweave.operators.sheaf import learned_maps, residuals
from trailweave.operators.traversal import geodesic_paths
from trailweave.plans.query import query
from trailweave.sources import documents as D

ENGINE_MODES = ("graph", "topo", "sheaf", "reasoning")


def run_worlds(spark: SparkSession, worlds: int = 40, k: int = 5, modes=ENGINE_MODES, seed: int = 0) -> DataFrame:
    """Measures of the random floor, TF-IDF and the engine's modes on synthetic worlds, overall and by kind.

    Ties of TF-IDF go by the documents' order, and the floor is drawn by one seeded generator, as
    in the published figures: the corpus is small by its definition.
    """
    docs, asked = D.synthetic_worlds(spark, worlds, seed)
    objects, edges = D.split_documents(docs)
    names = [r["_id"] for r in docs.select("_id").collect()]
    order = spark.createDataFrame(list(enumerate(names)), "place int, _id string")
    texts = docs.join(order, "_id").select(F.col("place").alias("id"), F.col("content").alias("text"))
    lexical = retrieval.tfidf(asked, texts, k).join(order, F.col("id") == F.col("place")).select("qid", F.col("_id").alias("id"), "rank")
    qids = [r.qid for r in asked.orderBy("place").select("qid").collect()]
    floor = [(q, i, n) for q, own in zip(qids, D.shuffled_top(names, len(qids), k, seed), strict=True) for n, i in enumerate(own, 1)]
    found = [("random", spark.createDataFrame(floor, "qid string, id string, rank int")), ("lexical", lexical)]
    out = [(name, df.select("qid", F.col("id").alias("object_id"), "rank", F.lit(None).cast("array<string>").alias("relations"))) for name, df in found]
    for mode in modes:
        got = query(asked.select("qid", "text"), objects, edges, mode, k)
        out.append((f"engine-{mode}", got.select("qid", "object_id", "rank", F.transform("path", lambda p: p["relation"]).alias("relations"))))
    rows = None
    for name, df in out:
        own = metrics.retrieval_metrics(df, asked, k).withColumn("retriever", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return metrics.summarised(rows)


def run_examples(examples: DataFrame, k: int = 10, modes=("graph", "reasoning"), max_hops: int = 4, linker: str | None = None) -> DataFrame:
    """Measures of BM25 and the engine on multi-hop questions over one graph of all examples.

    Kept: questions whose answer and head entity are nodes. The anchor is the head entity, or
    what ``linker`` ("surface" or "bm25") finds for the question. A path match needs the gold
    relations; for BM25 it is null; a miss counts 0.
    """
    objects, edges = D.examples_graph(examples)
    first = F.get("evidences", F.lit(0))["s"]
    asked = examples.select("qid", F.col("question").alias("text"), F.col("qtype").alias("kind"), normalised(first).alias("gold_anchor"), normalised(F.col("answer")).alias("gold"), F.transform("evidences", lambda t: slug(t["r"])).alias("gold_path"))
    ids = objects.select("id")
    asked = asked.join(ids.withColumnRenamed("id", "gold_anchor"), "gold_anchor", "left_semi").join(ids.withColumnRenamed("id", "gold"), "gold", "left_semi").withColumn("answers", F.array("gold"))
    texts = objects.select("id", F.col("content").alias("text"))
    if linker is None:
        anchored = asked.select("qid", F.col("gold_anchor").alias("anchor"))
    elif linker == "surface":
        anchored = retrieval.surface_link(asked, ids.withColumnRenamed("id", "name"), 1).select("qid", F.col("name").alias("anchor"))
    elif linker == "bm25":
        anchored = retrieval.bm25(asked, texts, 1).select("qid", F.col("id").alias("anchor"))
    else:
        raise ValueError("linker is None, surface or bm25")
    bm = retrieval.bm25(asked, texts, k).select("qid", F.col("id").alias("object_id"), "rank", F.lit(None).cast("array<string>").alias("relations"))
    rows = metrics.retrieval_metrics(bm, asked, k).withColumn("retriever", F.lit("bm25")).withColumn("path_correct", F.lit(None).cast("double"))
    for mode in modes:
        got = query(anchored.withColumn("max_hops", F.lit(max_hops)), objects, edges, mode, k)
        got = got.select("qid", "object_id", "rank", F.transform("path", lambda p: p["relation"]).alias("relations"))
        rows = rows.unionByName(metrics.retrieval_metrics(got, asked, k).withColumn("retriever", F.lit(f"engine-{mode}")))
    linked = asked.join(anchored, "qid", "left").select("qid", F.coalesce(F.col("anchor") == F.col("gold_anchor"), F.lit(False)).cast("double").alias("link_correct"))
    return metrics.summarised(rows.join(linked, "qid"))


def run_extraction(spark: SparkSession) -> DataFrame:
    """Extraction scores of the rules on the annotated sentences."""
    texts, gold = D.gold_sentences(spark)
    return metrics.extraction_scores(extract_triples(texts, "doc"), gold)


def run_learned_maps(spark: SparkSession, dim: int = 16, noise: float = 0.1, per_relation: int = 60, held: float = 0.3, chains: int = 120, seed: int = 0, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``hops, maps, residual``: held-out residuals of placeholder and learned maps on seeded edges and chains."""
    rng = np.random.default_rng(seed)
    kinds = ("causes", "prevents", "requires", "part_of")
    unit = lambda v: v / np.linalg.norm(v)
    truth = {r: np.linalg.qr(rng.standard_normal((dim, dim)))[0] for r in kinds}
    stalks, train, test, walks = {}, [], [], []

    def node(v) -> str:
        stalks[f"n{len(stalks)}"] = v
        return f"n{len(stalks) - 1}"

    onward = lambda r, x: unit(truth[r] @ x + noise * rng.standard_normal(dim))
    for r in kinds:
        for i in range(per_relation):
            x = unit(rng.standard_normal(dim))
            (test if i < int(per_relation * held) else train).append((node(x), r, node(onward(r, x))))
    for _ in range(chains):
        r1, r2 = rng.choice(kinds, 2)
        x = unit(rng.standard_normal(dim))
        walks.append((node(x), [str(r1), str(r2)], node(onward(r2, onward(r1, x)))))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in stalks.items()], "id string, sheaf_stalk array<double>")
    maps = learned_maps(spark.createDataFrame(train, "src string, relation string, dst string"), table, vocabulary)
    rows = spark.createDataFrame([(1, a, [(a, r, b, 1.0)], b) for a, r, b in test] + [(2, a, [(a, r, b, 1.0) for r in rs], b) for a, rs, b in walks], "hops int, anchor string, path array<struct<source:string,relation:string,target:string,weight:double>>, object_id string")
    out = None
    for name, own in (("placeholder", None), ("learned", maps)):
        part = residuals(rows, dim, table, vocabulary, own).groupBy("hops").agg(F.avg("sheaf").alias("residual")).select("hops", F.lit(name).alias("maps"), "residual")
        out = part if out is None else out.unionByName(part)
    return out


def entity_texts(examples: DataFrame) -> DataFrame:
    """``id, text, from_paragraph``: the longest paragraph under any alias of its title, else the name."""
    longest = D.first_of_longest(examples, alias_keys(F.col("c.title")))
    named = examples.select(F.explode("evidences").alias("t")).select(F.explode(F.array("t.s", "t.o")).alias("name")).select(normalised(F.col("name")).alias("id"), "name").where("id <> ''").groupBy("id").agg(F.min("name").alias("name"))
    both = longest.join(named, "id", "full")
    return both.select("id", F.coalesce("text", "name").alias("text"), F.col("text").isNotNull().alias("from_paragraph"))


def chains(examples: DataFrame) -> DataFrame:
    """``qid, source, relations, target, triples`` of examples whose triples form one path."""
    t = F.transform("evidences", lambda e: F.struct(normalised(e["s"]).alias("s"), e["r"].alias("r"), normalised(e["o"]).alias("o")))
    own = examples.where(F.size("evidences") > 0).select("qid", t.alias("triples"))
    joined = F.forall(F.zip_with("triples", F.slice("triples", 2, F.size("triples")), lambda a, b: F.coalesce(a["o"] == b["s"], F.lit(True))), lambda ok: ok)
    return own.where(joined).select("qid", F.get("triples", F.lit(0))["s"].alias("source"), F.transform("triples", lambda x: x["r"]).alias("relations"), F.element_at("triples", -1)["o"].alias("target"), "triples")


def corrupted(own: DataFrame, seed: int = 0) -> DataFrame:
    """``qid, kind, source, relations, target``: one seeded negative of each kind that fits a chain.

    relation_swap, tail_swap, source_swap and shuffle (another order of the relations, by a hash
    of each place; of eight tries the first that differs). Other relations are the vocabulary's,
    other entities those of all chains; both are drawn from rings of distinct values, joined by
    place, so nothing is collected.
    """
    draw = lambda *salt: F.xxhash64("qid", *map(F.lit, (seed, *salt)))

    def ring(values: DataFrame) -> tuple[DataFrame, Column]:
        """Distinct ``e`` with places from 0, and their number."""
        ranked = numbered(values.distinct(), ["e"])
        return written(ranked.select("e", (F.col("at") - 1).alias("place")), "ring"), F.greatest(values.agg(F.countDistinct("e")).scalar(), F.lit(1))

    def drawn(of: tuple[DataFrame, Column], salt: str, unlike: Column, tries: Column) -> DataFrame:
        """``qid, e``: the first value from a chain's own place on that is unlike its own."""
        values, n = of
        asked = own.withColumn("j", F.explode(F.sequence(F.lit(0), tries))).withColumn("place", F.pmod(draw(salt) + F.col("j"), n))
        return asked.join(values, "place").where(unlike).groupBy("qid").agg(F.min_by("e", "j").alias("e"))

    words = ring(own.select(F.explode("relations").alias("e")))
    other = drawn(words, "pick", ~F.array_contains("relations", F.col("e")), F.size("relations"))
    at = F.pmod(draw("at"), F.size("relations"))
    swap = F.transform("relations", lambda r, i: F.when(i == at, F.col("e")).otherwise(r))
    out = own.join(other, "qid").select("qid", F.lit("relation_swap").alias("kind"), "source", swap.alias("relations"), "target")
    order = lambda t: F.transform(F.array_sort(F.transform("relations", lambda r, i: F.struct(F.xxhash64("qid", F.lit(seed), t, i).alias("h"), i.alias("i"), r.alias("r")))), lambda x: x["r"])
    shuffled = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), order), lambda x: x != F.col("relations")), F.lit(0))
    out = out.unionByName(own.select("qid", F.lit("shuffle").alias("kind"), "source", shuffled.alias("relations"), "target").where("relations is not null"))
    entities = ring(own.select(F.explode(F.array("source", "target")).alias("e")))
    for kind, column in (("tail_swap", "target"), ("source_swap", "source")):
        # Three places for each chain: at least one is neither of its ends.
        hit = drawn(entities, kind, (F.col("e") != F.col("source")) & (F.col("e") != F.col("target")), F.lit(2))
        part = own.join(hit, "qid").withColumn(column, F.col("e"))
        out = out.unionByName(part.select("qid", F.lit(kind).alias("kind"), "source", "relations", "target"))
    return out


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A report table; numbers with three decimals, null as n/a. Rows come one partition at a time, all of them."""
    show = lambda v: "n/a" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    head = [f"| {' | '.join(columns)} |", "|" + "---|" * len(columns)]
    return "\n".join([*head, *(f"| {' | '.join(show(v) for v in r)} |" for r in rows.select(*columns).toLocalIterator())])


#: Reports: heading, and the columns that it shows of a run's rows.
REPORTS = {
    "worlds": ("Retrieval on synthetic worlds", ("retriever", "kind", "n", "hits_at_1", "hits_at_k", "precision_at_k", "recall_at_k", "reciprocal_rank", "path_correct")),
    "examples": ("Multi-hop questions", ("retriever", "kind", "n", "link_correct", "hits_at_k", "reciprocal_rank", "path_correct")),
    "extraction": ("Triple extraction", ("n_gold", "n_predicted", "n_exact", "precision", "recall", "f1", "relation_accuracy")),
    "projection": ("Accuracy over hops", ("hops", "accuracy")),
    "maps": ("Learned restriction maps", ("hops", "maps", "residual")),
    "probe": ("True chains against corrupted ones", ("maps", "kind", "n", "auc", "win_rate", "median_gold", "median_other")),
    "scale": ("Traversal over graph sizes", ("objects", "anchors", "seconds", "anchors_per_second")),
    "requests": ("Requests", ("path", "status", "n", "mean_latency")),
}


def report(name: str, rows: DataFrame, form: str = "markdown") -> str:
    """A run's rows as a Markdown section, or as JSON (``form`` "json"), sorted by their first columns."""
    title, columns = REPORTS[name]
    own = rows.select(*[c for c in columns if c in rows.columns])
    own = own.orderBy(*own.columns[:3])
    if form == "json":
        return json.dumps({"report": name, "rows": [json.loads(r[0]) for r in own.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]})
    return f"## {title}\n\n{markdown(own, own.columns)}"


def run_scale(spark: SparkSession, sizes=(1_000, 10_000, 50_000), anchors: int = 1_000, degree: int = 4, max_hops: int = 4, seed: int = 0) -> DataFrame:
    """``objects, anchors, seconds, anchors_per_second``: four-hop traversals of random graphs, all anchors as one batch."""
    rows = []
    for n in sizes:
        _, edges = D.random_graph(spark, n, degree, seed)
        edges = written(edges, "graph")
        asked = spark.range(min(anchors, n)).select(F.col("id").alias("qid"), F.concat(F.lit("n"), F.col("id") * (n // min(anchors, n))).alias("anchor"), F.lit(max_hops).alias("max_hops"))
        began = time.perf_counter()
        geodesic_paths(asked, edges, paths=False).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        rows.append((n, min(anchors, n), seconds, min(anchors, n) / seconds))
    return spark.createDataFrame(rows, "objects long, anchors long, seconds double, anchors_per_second double")


def run_probe(examples: DataFrame, dim: int = 32, held: float = 0.3, seed: int = 0, max_hops: int = 3, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``maps, kind, n, auc, win_rate, median_gold, median_other, degenerate``: can residuals tell true chains from corrupted ones?

    Chains are split by a seeded hash; edges of held-out chains are no evidence for the learned
    maps. Families: placeholder, identity (no map moves anything) and learned. ``kind`` null is
    all corruptions together. degenerate: all learned maps are the identity.
    """
    own = chains(examples)
    test = own.where(F.pmod(F.xxhash64(F.lit(seed), "qid"), F.lit(1000)) < int(1000 * held))
    pairs = lambda df: df.select(F.explode("triples").alias("t")).select(F.col("t.s").alias("src"), F.col("t.r").alias("relation"), F.col("t.o").alias("dst")).distinct()
    every = examples.select(F.explode("evidences").alias("t")).select(normalised(F.col("t.s")).alias("src"), F.col("t.r").alias("relation"), normalised(F.col("t.o")).alias("dst")).distinct()
    train = every.join(pairs(test), ["src", "relation", "dst"], "left_anti")
    from trailweave.operators.sheaf import text_stalks
    from trailweave.operators.traversal import detours

    stalks = text_stalks(entity_texts(examples), dim, seed)
    learned = learned_maps(train, stalks, vocabulary)
    names = [r[0] for r in every.select("relation").distinct().collect()]
    identity = {n: np.eye(dim) for n in names}
    other = detours(test, every, max_hops).join(test.select("qid", "source", "target"), "qid").select("qid", F.lit("detour").alias("kind"), "source", "relations", "target")
    bad = corrupted(test, seed).unionByName(other)
    rows = test.select("qid", F.lit("gold").alias("kind"), "source", "relations", "target").unionByName(bad)
    known = stalks.select("id")
    rows = rows.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    step = F.transform("relations", lambda r: F.struct(F.lit("").alias("source"), r.alias("relation"), F.lit("").alias("target"), F.lit(1.0).alias("weight")))
    rows = rows.select("qid", "kind", F.col("source").alias("anchor"), F.col("target").alias("object_id"), step.alias("path"))
    flat = bool(learned) and all(np.allclose(m, np.eye(len(m))) for m in learned.values())
    kinds = sorted(x[0] for x in bad.select("kind").distinct().collect())
    rows, out = written(rows, "chains"), []
    for name, maps in (("placeholder", None), ("identity", identity), ("learned", {**identity, **learned})):
        r = written(residuals(rows, dim, stalks, vocabulary, maps).select("qid", "kind", "sheaf"), "residuals")
        both = r.where("kind <> 'gold'").select("qid", "kind", F.col("sheaf").alias("other")).join(r.where("kind = 'gold'").select("qid", F.col("sheaf").alias("gold")), "qid")
        both = written(both, "pairs")
        for kind in (None, *kinds):
            part = both if kind is None else both.where(F.col("kind") == kind)
            gold = part.select("qid", F.col("gold").alias("score"), F.lit(True).alias("positive")).distinct().drop("qid")
            found = metrics.auc(gold.unionByName(part.select(F.col("other").alias("score"), F.lit(False).alias("positive")))).first()
            for w in metrics.win_rate(part, "gold", "other").where("n > 0").collect():
                out.append((name, kind, w.n, found.auc, w.win_rate, w.median_gold, w.median_other, flat and name == "learned"))
    return own.sparkSession.createDataFrame(out, "maps string, kind string, n bigint, auc double, win_rate double, median_gold double, median_other double, degenerate boolean")


def verdict(report: DataFrame, noise: float) -> str:
    """"degenerate", "signal" or "no signal": do learned maps beat both others by more than ``noise``?"""
    rows = {r.maps: r for r in report.where("kind is null").collect()}
    if rows["learned"].degenerate:
        return "degenerate"
    margin = rows["learned"].auc - max(rows["placeholder"].auc, rows["identity"].auc)
    return "signal" if margin > noise else "no signal"
