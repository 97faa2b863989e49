"""Evaluation measures over ranked results, scores and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.operators.ranges import medians, running


def retrieval_metrics(results: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """One row for each query: hits_at_1, hits_at_k, precision_at_k, recall_at_k, reciprocal_rank, path_correct.

    ``results``: qid, object_id, rank and optional relations (array<string>). ``queries``: qid,
    kind, answers, gold_path. Precision divides by k; path_correct is null without a gold path,
    else whether the first correct answer came by exactly that path. Queries without results count.
    """
    if "relations" not in results.columns:
        results = results.withColumn("relations", F.lit(None).cast("array<string>"))
    both = queries.select("qid", "kind", "answers", "gold_path").join(results.select("qid", "object_id", "rank", "relations"), "qid", "left")
    hit = F.coalesce(F.array_contains("answers", F.col("object_id")), F.lit(False))
    near = hit & (F.col("rank") <= k)
    out = both.groupBy("qid").agg(
        F.first("kind").alias("kind"), F.first("answers").alias("answers"), F.first("gold_path").alias("gold_path"),
        F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if(near).alias("n"), F.min_by(F.when(hit, F.struct("relations")), F.when(hit, F.col("rank"))).alias("way"),
    )
    as_double = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    has_path = F.coalesce(F.size("gold_path") > 0, F.lit(False))
    return out.select(
        "qid", "kind", as_double(F.col("first") <= 1).alias("hits_at_1"), as_double(F.col("first") <= k).alias("hits_at_k"), (F.col("n") / k).alias("precision_at_k"),
        F.when(F.size("answers") > 0, F.col("n") / F.size("answers")).otherwise(0.0).alias("recall_at_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(has_path, as_double(F.col("way.relations") == F.col("gold_path"))).alias("path_correct"),
    )


def summarised(metrics: DataFrame, by: str = "kind") -> DataFrame:
    """Means of every measure over all queries (``by`` null) and for each kind, in one pass; nulls are skipped."""
    names = [c for c in metrics.columns if c not in ("qid", "kind", "retriever")]
    keys = ["retriever"] if "retriever" in metrics.columns else []
    sets = metrics.groupingSets([[*keys], [*keys, by]], *keys, by)
    return sets.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names])


def auc(scores: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """``auc``: how often a positive scores lower than a negative, ties a half; null if one side is missing.

    From counts of each distinct score and their running sum, ordered by range: no pairs.
    """
    each = scores.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("m"))
    full = running(each, "p", [], ["s"])
    wins = F.sum(F.col("m") * (F.col("upto") - F.col("p") / 2))
    return full.agg((wins / F.nullif(F.sum("p") * F.sum("m"), F.lit(0))).alias("auc"))


def nearest_rank(values: DataFrame, value: str, percents: list[float], by: list[str]) -> DataFrame:
    """``by, percent, value``: the value at rank round-half-even(p/100 n), from 1 to n.

    Equal values are counted first, and counts are summed over ranges, so a group of any size
    spreads over tasks.
    """
    each = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    rank = lambda p: F.greatest(F.lit(1), F.least(F.col("n"), F.bround(p / 100 * F.col("n")).cast("long")))
    asked = F.transform(F.array(*[F.lit(float(p)) for p in percents]), lambda p: F.struct(p.alias("percent"), rank(p).alias("k")))
    run = running(each, "c", by, ["v"]).select("*", F.inline(asked))
    return run.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k"))).select(*by, "percent", F.col("v").alias("value"))


def extraction_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """``n_predicted, n_gold, n_exact, precision, recall, f1, relation_accuracy``.

    Both: doc, subject, relation, object. Subjects and objects are compared as tokens without
    articles. Relation accuracy is over predictions whose two arguments a gold triple has; of
    several gold triples with the same arguments the last one (by ``ord``, if given) counts.
    """
    from trailweave.functions.text import without_articles

    def keyed(df: DataFrame) -> DataFrame:
        order = F.col("ord") if "ord" in df.columns else F.monotonically_increasing_id()
        return df.select("doc", without_articles(F.col("subject")).alias("s"), "relation", without_articles(F.col("object")).alias("o"), order.alias("ord"))

    p, g = keyed(predicted).drop("ord").distinct(), keyed(gold)
    exact = p.join(g.drop("ord").distinct(), ["doc", "s", "relation", "o"], "left_semi").agg(F.count(F.lit(1)).alias("n_exact"))
    last = g.groupBy("doc", "s", "o").agg(F.max_by("relation", "ord").alias("gold_relation"))
    args = p.join(last, ["doc", "s", "o"]).agg(F.count(F.lit(1)).alias("n_args"), F.count_if(F.col("relation") == F.col("gold_relation")).alias("n_same"))
    counts = p.agg(F.count(F.lit(1)).alias("n_predicted")).withColumn("_one", F.lit(1))
    for part in (g.select("doc", "s", "relation", "o").distinct().agg(F.count(F.lit(1)).alias("n_gold")), exact, args):
        counts = counts.join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    out = counts.withColumns({"precision": share("n_exact", "n_predicted"), "recall": share("n_exact", "n_gold"), "relation_accuracy": share("n_same", "n_args")})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.select("n_predicted", "n_gold", "n_exact", "precision", "recall", f1.alias("f1"), "relation_accuracy")


def projected_accuracy(spark, p: float, hops: int = 4) -> DataFrame:
    """``hops, accuracy``: p to the power of each number of hops."""
    return spark.range(1, hops + 1).select(F.col("id").alias("hops"), F.pow(F.lit(p), F.col("id")).alias("accuracy"))


def win_rate(pairs: DataFrame, gold: str, other: str, by: list[str] | None = None) -> DataFrame:
    """Share of pairs whose gold score is strictly lower, with medians of both, for each of ``by``."""
    keys = by or ["_all"]
    own = pairs if by else pairs.withColumn("_all", F.lit(1))
    out = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(gold) < F.col(other)).cast("double")).alias("win_rate"))
    for column, name in ((gold, "median_gold"), (other, "median_other")):
        out = out.join(medians(own, column, keys, name), keys, "left")
    return out.select(*(by or []), "n", "win_rate", "median_gold", "median_other")


def rate_limited(requests: DataFrame, limit: int, client: str = "user_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """``requests`` with ``window_start, allowed, retry_after``: ``limit`` calls in each full minute.

    Rejected calls don't count, so the first ``limit`` of a client's minute pass.
    """
    minute = F.date_trunc("minute", F.col(ts))
    n = F.row_number().over(W.partitionBy(client, minute).orderBy(ts, order))
    left = (60 - F.pmod(F.unix_timestamp(F.col(ts)), F.lit(60))).cast("int")
    return requests.withColumn("window_start", minute).withColumn("_n", n).withColumn("allowed", F.col("_n") <= limit).withColumn("retry_after", F.when(~F.col("allowed"), left).otherwise(0)).drop("_n")


def request_metrics(requests: DataFrame, path: str, status: str, latency: str) -> DataFrame:
    """Counts and mean latency of every path and status."""
    return requests.groupBy(path, status).agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("mean_latency"))
