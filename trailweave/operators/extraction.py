"""Rule-based triples and intents from text, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trailweave.functions.vocabulary import Vocabulary

# Keywords in order of preference, each with its relation.
KEYWORDS = (
    ("compatible", "compatible_with"), ("conflict", "contradicts"), ("contradict", "contradicts"), ("prevent", "prevents"),
    ("block", "prevents"), ("cause", "causes"), ("require", "requires"), ("depend", "requires"), ("part of", "part_of"),
    ("contains", "has_part"), ("kind of", "is_a"), ("type of", "is_a"), ("is a", "is_a"), ("conform", "conforms_to"),
    ("similar", "similar_to"), ("used in", "used_in"),
)


#: Letters of an id that are joined to a text.
KEY = 24


def _keyword(lowered: Column) -> Column:
    """struct(word, relation, at) of the first keyword in the list that occurs; ``at`` from 1; null: none."""
    out = F.lit(None).cast("struct<word:string,relation:string,at:int>")
    for word, relation in reversed(KEYWORDS):
        at = F.instr(lowered, word)
        out = F.when(at > 0, F.struct(F.lit(word).alias("word"), F.lit(relation).alias("relation"), at.alias("at"))).otherwise(out)
    return out


def extract_triples(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, sentence, subject, relation, object, weight``: at most one triple for each sentence.

    Sentences end at . ; or a line break. The first keyword of the list that occurs splits the
    sentence; letters after it belong to it. Both sides lose spaces and commas at their ends and
    must not be empty. Null text has none.
    """
    own = docs.select(F.col(id), F.posexplode(F.split(F.col(text), "[.\n;]")).alias("sentence", "_s"))
    any_word = "|".join(w for w, _ in KEYWORDS)
    own = own.withColumn("_l", F.lower("_s")).where(F.rlike("_l", F.lit(any_word)))
    own = own.withColumn("_k", _keyword(F.col("_l")))
    tail = F.substring(F.col("_s"), F.col("_k.at") + F.length("_k.word"), F.length("_s"))
    before = F.substring(F.col("_s"), F.lit(1), F.col("_k.at") - 1)
    strip = lambda c: F.regexp_replace(c, r"^[ ,]+|[ ,]+$", "")
    out = own.select(id, "sentence", strip(before).alias("subject"), F.col("_k.relation").alias("relation"), strip(F.regexp_replace(tail, r"^\p{L}+", "")).alias("object"), F.lit(1.0).alias("weight"))
    return out.where("subject <> '' and object <> ''")


def registered(triples: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Triples whose relation the vocabulary knows."""
    return triples.where(F.col("relation").isin(vocabulary.names()))


def parse_intents(queries: DataFrame, ids: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``queries`` (qid, text) with anchor, relation, target and chain.

    Ids that occur in the text in any case, by place, longer ones first, then by id: the first is
    the anchor, the second the target. A single id after the keyword is its object, so the
    relation turns into its inverse where it has one.

    An id can stand anywhere in a word, so texts are cut at every place into pieces, one for each
    length that ids have, and joined to whole ids; of ids longer than ``KEY`` the first so many
    letters are joined and the rest is held against the text. Lengths come to at most KEY.
    """
    text = queries.where("text is not null").select("qid", F.lower("text").alias("_l"))
    known = ids.where("id is not null and id <> ''").select(F.col("id"), F.lower("id").alias("_i"))
    keyed = known.withColumn("key", F.substring("_i", 1, KEY))
    sizes = sorted(r[0] for r in keyed.select(F.length("key")).distinct().collect())  # at most KEY
    pieces = F.array(*[F.substring("_l", F.col("at"), F.lit(n)) for n in sizes]).cast("array<string>")
    places = text.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_l"))))).withColumn("key", F.explode(F.array_distinct(pieces))).where("key <> ''")
    hit = F.substring(F.col("_l"), F.col("at"), F.length("_i")) == F.col("_i")
    first = places.join(keyed, "key").where(hit).groupBy("qid", "id").agg(F.min("at").alias("at"))
    order = W.partitionBy("qid").orderBy("at", F.length("id").desc(), "id")
    placed = first.withColumn("n", F.row_number().over(order)).where("n <= 2")
    two = placed.groupBy("qid").agg(F.max(F.when(F.col("n") == 1, F.col("id"))).alias("anchor"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("target"), F.max(F.when(F.col("n") == 1, F.col("at"))).alias("_at"))
    out = queries.withColumn("_k", _keyword(F.lower("text"))).join(two, "qid", "left")
    inverse = vocabulary.inverse_column(F.col("_k.relation"))
    turned = F.when(F.col("target").isNull() & (F.col("_at") > F.col("_k.at")), F.coalesce(inverse, F.col("_k.relation"))).otherwise(F.col("_k.relation"))
    return out.withColumn("relation", turned).withColumn("chain", F.when(F.col("relation").isNotNull(), F.array("relation"))).drop("_k", "_at")
