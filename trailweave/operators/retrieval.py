"""Lexical retrieval over postings: TF-IDF, BM25, and entity linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.cluster import written
from trailweave.functions.text import normalised, tokens
from trailweave.operators.ranges import numbered


def postings(docs: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """``id, term, tf``. Null text has no terms."""
    return docs.select(F.col(id).alias("id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query by score (rounded to 9 digits), ties by id: a top-k report."""
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tfidf(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """``qid, id, score, rank``: cosine of raw tf times ln((1+n)/(1+df))+1 vectors.

    Documents without a shared term score 0 and follow, in order of id, where fewer than ``k`` share one.
    """
    posted = written(postings(docs), "postings")
    n = docs.agg(F.count(F.lit(1))).scalar()
    idf = document_frequency(posted).select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = posted.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = postings(queries, "qid").withColumnsRenamed({"id": "qid", "tf": "qtf"}).join(idf, "term").withColumn("qw", F.col("qtf") * F.col("idf"))
    lengths = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = asked.select("qid", "term", "qw").join(weighed.select("id", "term", "w"), "term").groupBy("qid", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    scores = dots.join(norms, "id").join(lengths, "qid").select("qid", "id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))
    best = top_k(scores, k).drop("rank")
    first = docs.select("id").orderBy("id").limit(2 * k).agg(F.array_sort(F.collect_list("id"))).scalar()
    rest = queries.select("qid", F.explode(first).alias("id"), F.lit(0.0).alias("score"))
    rest = rest.join(best.select("qid", "id"), ["qid", "id"], "left_anti")
    return top_k(best.unionByName(rest), k)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``qid, id, score, rank`` by Okapi BM25; a term that a query repeats counts as often.

    Documents without text count among all and in the mean length.
    """
    posted = written(postings(docs), "postings")
    sizes = docs.select("id", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).alias("len")).withColumn("len", F.greatest("len", F.lit(0)))
    n, mean, df = sizes.agg(F.count(F.lit(1))).scalar(), sizes.agg(F.avg("len")).scalar(), F.col("df")
    idf = F.greatest(F.lit(1e-6), F.log((n - df + 0.5) / (df + 0.5) + 1))
    terms = document_frequency(posted).select("term", idf.alias("idf"))
    asked = postings(queries, "qid").withColumnsRenamed({"id": "qid", "tf": "qtf"}).join(terms, "term")
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / mean))
    scores = asked.join(posted.join(sizes, "id"), "term").groupBy("qid", "id").agg(F.sum(part).alias("score")).where("score > 0")
    return top_k(scores, k)


def random_top(queries: DataFrame, docs: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """The floor: ``k`` documents for each query in the order of a seeded hash.

    The documents' order is one ring, and each query starts at its own place, so no pairs of all
    queries and documents are formed.
    """
    size = docs.count()
    ring = numbered(docs.select("id", F.xxhash64(F.lit(seed), "id").alias("h")), ["h", "id"]).select("id", "at")
    want = queries.select("qid", F.explode(F.sequence(F.lit(0), F.lit(min(k, size) - 1))).alias("j")) if size else queries.select("qid", F.lit(0).alias("j")).where("false")
    want = want.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "qid") + F.col("j"), F.lit(max(1, size))) + 1)
    return want.join(ring, "at").select("qid", "id", F.lit(0.0).alias("score"), (F.col("j") + 1).alias("rank"))


def surface_link(questions: DataFrame, names: DataFrame, k: int = 20) -> DataFrame:
    """``qid, name, score, rank``: entity names by what of them stands in a question (qid, text).

    Sum of ln(N/(1+df))+1 over shared tokens, doubled if all of the name's are there, times 1.5 if
    the name stands there as a whole, plus 0.01 for each shared token. Ties: the later name first.
    Names (name) are distinct and normalised; a question and a name meet by a shared token only.
    """
    distinct = names.where("name is not null").select("name").distinct()
    own = distinct.withColumn("toks", F.array_distinct(tokens(F.col("name"))))
    posted = own.select("name", F.size("toks").alias("size"), F.explode("toks").alias("term"))
    n = distinct.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    idf = document_frequency(posted).select("term", (F.log(n / (1 + F.col("df"))) + 1).alias("idf"))
    q = questions.select("qid", normalised(F.col("text")).alias("q"))
    asked = q.select("qid", F.explode(F.array_distinct(tokens(F.col("q")))).alias("term"))
    met = asked.join(posted.join(idf, "term"), "term").groupBy("qid", "name", "size").agg(F.sum("idf").alias("s"), F.count(F.lit(1)).alias("m")).join(q, "qid")
    whole = F.contains(F.concat(F.lit(" "), "q", F.lit(" ")), F.concat(F.lit(" "), "name", F.lit(" ")))
    score: Column = F.col("s") * F.when(F.col("m") == F.col("size"), 2.0).otherwise(1.0) * F.when(whole, 1.5).otherwise(1.0) + 0.01 * F.col("m")
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("name").desc())
    return met.select("qid", "name", F.round(score, 9).alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
