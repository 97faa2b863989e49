"""Knowledge documents, demo graphs, generators, and graphs from other tables."""

from __future__ import annotations

import json
import random
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailweave.cluster import unscoped, written
from trailweave.functions.text import normalised, slug

OBJECTS = "id string, content string, vector array<double>, meta string"
EDGES = "src string, relation string, dst string, weight double, meta string, ord bigint"
_EDGE = T.StructType([T.StructField("relation", T.StringType()), T.StructField("target", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("meta", T.StringType())])
DOCUMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("_id", "id", "content", "text")]
    + [T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("meta", T.StringType()), T.StructField("edges", T.ArrayType(_EDGE))]
)


def edge_row(value: Mapping | Sequence) -> tuple:
    """An edge from a mapping, or from (relation, target) or (relation, target, weight); else TypeError."""
    if isinstance(value, Mapping):
        meta = value.get("meta")
        return value["relation"], value["target"], float(value.get("weight", 1.0)), json.dumps(meta, sort_keys=True) if meta else None
    if isinstance(value, Sequence) and not isinstance(value, str) and len(value) in (2, 3):
        return value[0], value[1], float(value[2]) if len(value) == 3 else 1.0, None
    raise TypeError(f"not an edge: {value!r}")


def documents(spark: SparkSession, rows: Iterable[Mapping]) -> DataFrame:
    """Documents given in the program as a DataFrame of the document schema."""
    out = [
        (d.get("_id"), d.get("id"), d.get("content"), d.get("text"), None if d.get("vector") is None else [float(x) for x in d["vector"]], json.dumps(d["meta"], sort_keys=True) if d.get("meta") else None, [edge_row(e) for e in d.get("edges") or ()])
        for d in rows
    ]
    return spark.createDataFrame(out, DOCUMENT)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines documents; meta may be any JSON value and is kept as text."""
    raw = T.StructType([f if f.name not in ("meta", "edges") else T.StructField(f.name, T.VariantType() if f.name == "meta" else T.ArrayType(T.VariantType())) for f in DOCUMENT])
    rows = spark.read.schema(raw).json(path)
    one = lambda e: F.when(
        F.schema_of_variant(e).startswith("OBJECT"),
        F.struct(F.try_variant_get(e, "$.relation", "string").alias("relation"), F.try_variant_get(e, "$.target", "string").alias("target"), F.coalesce(F.try_variant_get(e, "$.weight", "double"), F.lit(1.0)).alias("weight"), F.to_json(F.try_variant_get(e, "$.meta", "variant")).alias("meta")),
    ).otherwise(F.struct(F.try_variant_get(e, "$[0]", "string").alias("relation"), F.try_variant_get(e, "$[1]", "string").alias("target"), F.coalesce(F.try_variant_get(e, "$[2]", "double"), F.lit(1.0)).alias("weight"), F.lit(None).cast("string").alias("meta")))
    return rows.withColumn("edges", F.transform("edges", one)).withColumn("meta", F.to_json("meta"))


def identified(docs: DataFrame) -> DataFrame:
    """With ``id`` from _id, id or a fresh one, and ``content`` from content or text; empty counts as missing."""
    given = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    out = docs.withColumn("id", F.coalesce(given("_id", "id"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
    return out.withColumn("content", F.coalesce(given("content", "text"), F.lit(""))).drop("_id", "text")


def split_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) of documents. ``ord`` keeps the order in which a target was first named, then the edge's own.

    Of edges with the same source, relation and target the last one stays. Fresh ids are random,
    so write documents without ids before they are read twice.
    """
    own = identified(docs)
    flat = own.select(F.col("id").alias("src"), F.posexplode("edges").alias("pos", "e")).select("src", "pos", "e.*")
    last = flat.groupBy("src", "relation", F.col("target").alias("dst")).agg(F.max_by(F.struct("weight", "meta"), "pos").alias("v"), F.min("pos").alias("first"))
    named = flat.groupBy("src", F.col("target").alias("dst")).agg(F.min("pos").alias("at"))
    out = last.join(named, ["src", "dst"]).select("src", "relation", "dst", F.coalesce("v.weight", F.lit(1.0)).alias("weight"), "v.meta", (F.col("at").cast("bigint") * (1 << 20) + F.col("first")).alias("ord"))
    return own.select("id", "content", "vector", "meta"), out


def to_json(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document for each object, with its edges in order; empty parts are left out."""
    e = F.struct("ord", F.struct("relation", F.col("dst").alias("target"), "weight", "meta").alias("e"))
    own = edges.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x["e"]).alias("edges"))
    full = objects.join(own, "id", "left")
    return full.select("id", F.to_json(F.struct(F.col("id").alias("_id"), *[c for c in ("content", "vector", "meta", "edges") if c in full.columns])).alias("json"))


# The demo graphs.
DEMOS = {
    "umbrella": (
        ("umbrella", "a device that blocks rain", (("prevents", "rain"),)), ("rain", "falling water from clouds", (("causes", "wet_coat"),)),
        ("wet_coat", "a coat soaked by water", ()), ("raincoat", "waterproof coat", (("prevents", "wet_coat"),)),
        ("storm", "violent weather", (("causes", "rain"),)), ("sunshine", "clear bright weather", (("contradicts", "rain"),)),
    ),
    "pipe": (
        ("pipe_120mm", "120mm HDPE pipe", (("similar_to", "pipe_130mm"), ("conforms_to", "iso_4422"))), ("pipe_130mm", "130mm HDPE pipe", (("compatible_with", "fitting_B"),)),
        ("fitting_B", "flanged fitting B", (("requires", "adapter_ring"),)), ("adapter_ring", "reducing adapter ring", (("used_in", "steel_pipe"),)),
        ("steel_pipe", "galvanised steel pipe", (("contradicts", "iso_4422"),)), ("iso_4422", "ISO 4422 PVC pressure-pipe standard", ()),
    ),
    "deps": (
        ("checkout_api", "payment checkout HTTP service", (("depends_on", "web_framework"), ("depends_on", "fast_json"))),
        ("auth_service", "authentication service", (("depends_on", "web_framework"), ("depends_on", "crypto_utils"))),
        ("billing_worker", "async billing job runner", (("depends_on", "fast_json"), ("depends_on", "pdf_gen"))),
        ("docs_portal", "static documentation site", (("depends_on", "markdown_lib"),)),
        ("web_framework", "HTTP web framework", (("depends_on", "http_core"),)),
        ("http_core", "low-level HTTP engine", (("depends_on", "tinyparse"),)),
        ("fast_json", "fast JSON (de)serialiser", (("depends_on", "tinyparse"),)),
        ("crypto_utils", "crypto helpers", (("depends_on", "bignum"),)),
        ("pdf_gen", "PDF generation library", (("depends_on", "image_lib"),)),
        ("tinyparse", "tiny tokeniser/parser", (("affected_by", "CVE_2024_5001"),)),
        ("image_lib", "image decoding library", (("affected_by", "CVE_2023_9002"),)),
        ("markdown_lib", "markdown renderer (no known CVE)", ()),
        ("bignum", "big-integer arithmetic (no known CVE)", ()),
        ("CVE_2024_5001", "critical RCE in tinyparse parser", ()),
        ("CVE_2023_9002", "high-severity heap overflow in image_lib", ()),
    ),
}

# Annotated sentences, each with its triples.
GOLD_SENTENCES = (
    ("Aspirin prevents clotting.", (("aspirin", "prevents", "clotting"),)),
    ("The umbrella prevents the rain.", (("umbrella", "prevents", "rain"),)),
    ("Penicillin causes an allergic reaction.", (("penicillin", "causes", "allergic reaction"),)),
    ("Smoking causes cancer.", (("smoking", "causes", "cancer"),)),
    ("Warfarin contradicts aspirin.", (("warfarin", "contradicts", "aspirin"),)),
    ("The new policy contradicts the old guidance.", (("new policy", "contradicts", "old guidance"),)),
    ("Steel beams require proper support.", (("steel beams", "requires", "proper support"),)),
    ("The engine requires fuel.", (("engine", "requires", "fuel"),)),
    ("Smoking leads to heart disease.", (("smoking", "causes", "heart disease"),)),
    ("The bridge collapsed due to corrosion.", (("corrosion", "causes", "bridge collapse"),)),
    ("Antibiotics ward off infection.", (("antibiotics", "prevents", "infection"),)),
    ("The valve requires a gasket and prevents leakage.", (("valve", "requires", "gasket"), ("valve", "prevents", "leakage"))),
    ("Vaccination prevents measles and reduces transmission.", (("vaccination", "prevents", "measles"), ("vaccination", "prevents", "transmission"))),
    ("Titanium is compatible with carbon fiber.", (("titanium", "compatible_with", "carbon fiber"),)),
    ("This grade of steel conforms to ISO 4422.", (("steel", "conforms_to", "iso 4422"),)),
    ("A flange is a kind of fitting.", (("flange", "is_a", "fitting"),)),
)


def demo(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    return split_documents(documents(spark, ({"_id": i, "content": c, "edges": e} for i, c, e in DEMOS[name])))


def gold_sentences(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(sentences: doc, text; gold triples: doc, subject, relation, object, ord)."""
    texts = [(k, t) for k, (t, _) in enumerate(GOLD_SENTENCES)]
    gold = [(k, *t, j) for k, (_, own) in enumerate(GOLD_SENTENCES) for j, t in enumerate(own)]
    return spark.createDataFrame(texts, "doc bigint, text string"), spark.createDataFrame(gold, "doc bigint, subject string, relation string, object string, ord bigint")


# The names of synthetic worlds, which published figures depend on, in their order.
WORLDS = (
    "amber azure basalt bronze cedar cobalt copper coral crimson cyan dusty ebony emerald flax frost garnet golden granite hazel indigo ivory jade khaki lilac linen maroon mauve mint ochre olive "
    "onyx opal pearl pewter plum quartz raven russet saffron sage sand scarlet sepia sienna silver slate steel tan teal topaz umber velvet verdant violet walnut willow amethyst beige blush brass "
    "carmine chartreuse denim fuchsia gilded glacier heather ice lemon magenta marble mocha navy peach rose ruby rust sky spruce tawny wheat"
).split()
# The objects of a world (content, edges), and the questions about it (mark, kind, text, answer, target, path).
WORLD_OBJECTS = {
    "shield": ("the {w} shield is a {w} protective device people carry", (("prevents", "storm"),)),
    "storm": ("the {w} storm is a {w} hazardous condition in the region", (("causes", "ruin"),)),
    "ruin": ("the {w} ruin is {w} structural harm left behind", ()),
    "spark": ("the {w} spark is a {w} originating trigger event", (("causes", "storm"),)),
    "cure": ("the {w} cure is a {w} remedy applied as a safeguard", (("prevents", "ruin"),)),
    "calm": ("the {w} calm is a {w} tranquil opposite state of affairs", (("contradicts", "storm"),)),
}
WORLD_QUESTIONS = (
    ("sh", "single_hop_inverse", "what prevents {w}_storm?", "shield", "storm", None, ()),
    ("fw", "single_hop", "what does {w}_shield prevent?", "storm", "shield", None, ()),
    ("mh", "multi_hop", "is {w}_shield connected to {w}_ruin?", "ruin", "shield", "ruin", ("prevents", "causes")),
    ("ct", "contradiction", "what contradicts {w}_storm?", "calm", "storm", None, ()),
)


def synthetic_worlds(spark: SparkSession, n: int = 40, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) of ``n`` worlds of six objects and four labelled questions each.

    The seed draws the worlds' names and the order of the questions (``place``), as published
    figures have them; there are as many worlds as names.
    """
    if not 0 <= n <= len(WORLDS):
        raise ValueError(f"0 to {len(WORLDS)} worlds have names")
    draw = random.Random(seed)
    names = draw.sample(WORLDS, n)
    rows = [{"_id": f"{w}_{role}", "content": text.format(w=w), "edges": [(r, f"{w}_{to}") for r, to in edges]} for w in names for role, (text, edges) in WORLD_OBJECTS.items()]
    asked = [
        (f"{w}-{mark}", kind, text.format(w=w), [f"{w}_{answer}"], f"{w}_{anchor}", target and f"{w}_{target}", list(path))
        for w in names for mark, kind, text, answer, anchor, target, path in WORLD_QUESTIONS
    ]
    draw.shuffle(asked)
    schema = "qid string, kind string, text string, answers array<string>, anchor string, target string, gold_path array<string>, place int"
    return documents(spark, rows), spark.createDataFrame([(*q, k) for k, q in enumerate(asked)], schema)


def shuffled_top(names: Sequence[str], queries: int, k: int, seed: int) -> list[list[str]]:
    """For each of ``queries`` the first ``k`` names of one more shuffle by one seeded generator."""
    draw, out = random.Random(seed), []
    for _ in range(queries):
        own = list(names)
        draw.shuffle(own)
        out.append(own[:k])
    return out


def random_graph(spark: SparkSession, n: int, degree: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) of ``n`` nodes with up to ``degree`` typed edges each and no loops, from seeded hashes."""
    kinds = F.array(*map(F.lit, ("causes", "prevents", "requires", "part_of", "related_to")))
    draw = lambda *salt: F.xxhash64("id", "j", *map(F.lit, (seed, *salt)))
    e = spark.range(n).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(degree - 1)))).withColumn("t", F.pmod(draw(1), F.lit(n)))
    e = e.where("t <> id").select(F.concat(F.lit("n"), "id").alias("src"), F.get(kinds, F.pmod(draw(2), F.lit(5)).cast("int")).alias("relation"), F.concat(F.lit("n"), "t").alias("dst"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("meta"), F.col("j").cast("bigint").alias("ord"))
    objects = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("node "), "id").alias("content"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("meta"))
    return objects, e.groupBy("src", "relation", "dst").agg(F.first("weight").alias("weight"), F.first("meta").alias("meta"), F.min("ord").alias("ord"))


def read_examples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Multi-hop questions from one JSON array: ``qid, place, question, answer, qtype, evidences, context``.

    Rows without evidences are dropped before ``limit`` counts. Inner tuples are JSON arrays of
    mixed types, so they are read as variants. Sentences of a paragraph are joined by a space.
    """
    rows = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = rows.select(F.variant_get("v", "$", "array<variant>").alias("a")).select(F.posexplode("a").alias("pos", "r"))
    get = lambda p, kind: F.try_variant_get("r", p, kind)
    three = F.transform(get("$.evidences", "array<array<string>>"), lambda t: F.struct(F.get(t, F.lit(0)).alias("s"), F.get(t, F.lit(1)).alias("r"), F.get(t, F.lit(2)).alias("o")))
    para = F.transform(get("$.context", "array<variant>"), lambda t: F.struct(F.try_variant_get(t, "$[0]", "string").alias("title"), F.array_join(F.try_variant_get(t, "$[1]", "array<string>"), " ").alias("text")))
    out = rows.select(F.coalesce(get("$._id", "string"), F.col("pos").cast("string")).alias("qid"), F.col("pos").alias("place"), get("$.question", "string").alias("question"), get("$.answer", "string").alias("answer"), F.coalesce(get("$.type", "string"), F.lit("unknown")).alias("qtype"), three.alias("evidences"), F.coalesce(para, F.expr("array()").cast("array<struct<title:string,text:string>>")).alias("context")).where(F.size("evidences") > 0)
    return out if limit is None else out.orderBy("place").limit(limit)


def first_of_longest(examples: DataFrame, names: Column) -> DataFrame:
    """``id, text``: the longest paragraph ``c`` under each of its ``names``, of equals the first."""
    place = F.col("place") if "place" in examples.columns else F.col("qid")
    para = examples.select(place.alias("place"), F.posexplode("context").alias("at", "c")).where("c.text <> ''")
    named = para.select(F.explode(names).alias("id"), F.col("c.text").alias("text"), "place", "at")
    return named.groupBy("id").agg(F.min_by("text", F.struct(-F.length("text"), F.col("place"), F.col("at"))).alias("text"))


def examples_graph(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) of all examples together: entities by normalised name, the longest paragraph as content.

    An entity without a paragraph has its name as content. Of paragraphs as long as each other the
    first stands: by the example's ``place`` (its qid, where there is none), then the paragraph's.
    """
    texts = first_of_longest(examples, F.array(normalised(F.col("c.title"))))
    longest = texts.withColumnRenamed("text", "content")
    triples = examples.select("qid", F.posexplode("evidences").alias("pos", "t")).select("qid", "pos", normalised(F.col("t.s")).alias("src"), slug(F.col("t.r")).alias("relation"), normalised(F.col("t.o")).alias("dst"))
    edges = triples.groupBy("src", "relation", "dst").agg(F.min(F.struct("qid", "pos")).alias("o"))
    edges = edges.select("src", "relation", "dst", F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("meta"), F.pmod(F.xxhash64("o.qid", "o.pos"), F.lit(1 << 40)).alias("ord"))
    nodes = longest.select("id").unionByName(triples.select(F.col("src").alias("id"))).unionByName(triples.select(F.col("dst").alias("id"))).distinct()
    objects = nodes.join(longest, "id", "left").select("id", F.coalesce("content", "id").alias("content"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("string").alias("meta"))
    return objects, edges


def star_graph(spark: SparkSession, sf_dir: str, merged: bool = True) -> tuple[DataFrame, DataFrame]:
    """(objects, edges) over the star schema: c placed o has_part p supplied_by s located_in n part_of r.

    Not ``merged``, a line is an edge of its own: for what asks only which nodes are reached.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, s, r, d, w: df.select(s.alias("src"), F.lit(r).alias("relation"), d.alias("dst"), w.alias("weight"))
    one, line = F.lit(1.0), F.col("l_linenumber").cast("double")
    lines = lambda a, b: t("lineitem").groupBy(a, b).agg(F.min("l_linenumber").alias("l_linenumber")) if merged else t("lineitem")
    n = t("nation")
    rivals = n.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("a")).join(n.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("b")), "region").where("a < b and (a + b) % 2 = 1")
    edges = (
        edge(t("orders"), key("c", "o_custkey"), "placed", key("o", "o_orderkey"), one)
        .unionByName(edge(lines("l_orderkey", "l_partkey"), key("o", "l_orderkey"), "has_part", key("p", "l_partkey"), line))
        .unionByName(edge(lines("l_partkey", "l_suppkey"), key("p", "l_partkey"), "supplied_by", key("s", "l_suppkey"), line))
        .unionByName(edge(t("supplier"), key("s", "s_suppkey"), "located_in", key("n", "s_nationkey"), one))
        .unionByName(edge(n, key("n", "n_nationkey"), "part_of", key("r", "n_regionkey"), one))
        .unionByName(edge(rivals, key("n", "a"), "contradicts", key("n", "b"), one))
    )
    obj = lambda name, kind, k, c: t(name).select(key(kind, k).alias("id"), F.col(c).alias("content"))
    objects = obj("customer", "c", "c_custkey", "c_name").unionByName(obj("part", "p", "p_partkey", "p_name")).unionByName(obj("supplier", "s", "s_suppkey", "s_name")).unionByName(obj("nation", "n", "n_nationkey", "n_name")).unionByName(obj("region", "r", "r_regionkey", "r_name")).unionByName(t("orders").select(key("o", "o_orderkey").alias("id"), F.col("o_orderpriority").alias("content")))
    # Out-edges of a node go by target: their order only breaks ties.
    return objects, edges.withColumn("ord", F.pmod(F.xxhash64("relation", "dst"), F.lit(1 << 40)))


_LOADED: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def driver_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``star_graph`` with its edges written to the shared folder, once for each application and folder.

    Edges lie by source, so a hop reads them and doesn't derive them again; they go with the application.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        objects, edges = star_graph(spark, sf_dir)
        with unscoped():
            _LOADED[key] = objects, written(edges.repartition("src").sortWithinPartitions("src"), "edges")
    return _LOADED[key]
