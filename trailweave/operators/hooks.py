"""Places for a caller's own extractor or linker, such as a remote model. None is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import shipped
from trailweave.functions.text import normalised
from trailweave.functions.vocabulary import Vocabulary
from trailweave.operators.extraction import parse_intents, registered
from trailweave.operators.retrieval import surface_link

Triples = Callable[[str], Iterable[tuple[str, str, str]]]
Intent = Callable[[str], tuple[str | None, str | None, str | None] | None]
Choice = Callable[[str, list[str]], str | None]


def extract_with(docs: DataFrame, extract: Triples, vocabulary: Vocabulary = Vocabulary(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, subject, relation, object, weight`` by ``extract``, called once for each text; unknown relations go."""
    shipped(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(i, *t, 1.0) for i, x in zip(pdf[id], pdf[text], strict=True) if x for t in extract(x)]
            yield pd.DataFrame(rows, columns=[id, "subject", "relation", "object", "weight"])

    found = docs.select(id, text).mapInPandas(run, f"`{id}` {kind}, subject string, relation string, object string, weight double")
    return registered(found, vocabulary)


def parse_with(queries: DataFrame, ids: DataFrame, parse: Intent, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``parse_intents`` with ``parse`` asked first, once for each text.

    Its answer (anchor, relation, target) counts if the anchor is a known id and the relation, if
    there is one, is registered; a target that isn't known is left out. Else the rules stand, as
    they do where ``parse`` gives None or raises.
    """
    shipped(queries.sparkSession)

    @F.pandas_udf("struct<anchor:string,relation:string,target:string>")
    def asked(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            try:
                out.append((parse(t) if t else None) or (None, None, None))
            except Exception:  # noqa: BLE001  a remote parser may fail in any way
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["anchor", "relation", "target"], dtype=object)

    rules = parse_intents(queries, ids, vocabulary)
    own = queries.select("qid", asked("text").alias("_p")).select("qid", "_p.*").where(F.col("anchor").isNotNull() & (F.col("relation").isNull() | F.col("relation").isin(vocabulary.names())))
    known = ids.select("id").distinct()
    own = own.join(known.withColumnRenamed("id", "anchor"), "anchor", "left_semi").join(known.select("id", F.col("id").alias("_t")), F.col("target") == F.col("id"), "left")
    own = own.select("qid", F.struct("anchor", "relation", F.col("_t").alias("target"), F.when(F.col("relation").isNotNull(), F.array("relation")).alias("chain")).alias("_own"))
    return rules.join(own, "qid", "left").withColumns({c: F.when(F.col("_own").isNotNull(), F.col(f"_own.{c}")).otherwise(F.col(c)) for c in ("anchor", "relation", "target", "chain")}).drop("_own")


def link_with(questions: DataFrame, names: DataFrame, choose: Choice, k: int = 20) -> DataFrame:
    """``qid, name``: the choice among the ``k`` best surface matches.

    A choice counts if it is a shortlisted name, or holds one, or is held by one, after
    normalising; else the best surface match stands.
    """
    shipped(questions.sparkSession)
    short = surface_link(questions, names, k).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))

    @F.pandas_udf("string")
    def chosen(text: pd.Series, options: pd.Series) -> pd.Series:
        return pd.Series([choose(t, list(o)) for t, o in zip(text, options, strict=True)], dtype=object)

    own = questions.join(short, "qid").withColumn("c", normalised(chosen("text", "names")))
    same = F.filter("names", lambda n: n == F.col("c"))
    near = F.filter("names", lambda n: (F.col("c") != "") & (F.contains(n, F.col("c")) | F.contains(F.col("c"), n)))
    return own.select("qid", F.coalesce(F.get(same, F.lit(0)), F.get(near, F.lit(0)), F.get("names", F.lit(0))).alias("name"))
