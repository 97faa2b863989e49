"""Personal data: base patterns, and terms that disclose a protected entity by co-occurrence.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import scratch, written
from trailweave.llm.prefilter import marked
from trailweave.llm.texts import short, text_key

#: Kinds in order, each with the pattern of its matches. Runs are possessive and may only start
#: where the run does (an email also where the last match ended), which leaves the matches of the
#: plain patterns as they are but takes linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A kind's match that may pass its check holds one of these; most texts don't.
GATES = PATTERNS | {"card": r"[0-9](?:[\x20-]?+[0-9]){11}", "phone": r"\+[0-9][\x20().0-9-]{8}"}
_IP = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
#: Share of an entity's information content that a term may disclose.
SHARE = 0.9
#: Standard errors by which p(entity|term) is lowered for documents that don't hold the entity.
DOUBT = 1.0
_CHUNK = 256


def _ends(lengths: Column) -> Column:
    """Running sums. In chunks, so that long arrays don't cost their square."""
    zero = F.lit(0).cast("bigint")
    within = F.aggregate(
        lengths, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero) + x))
    )
    parts = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(lengths) / _CHUNK).cast("int") - 1),
        lambda i: F.slice(lengths, i * _CHUNK + 1, _CHUNK),
    )
    sums = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
    before = F.aggregate(sums, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.try_element_at(acc, F.lit(-1)) + x)))
    chunked = F.flatten(
        F.zip_with(
            parts, F.slice(before, 1, F.size(sums)),
            lambda p, b: F.aggregate(p, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), b) + x))),
        )
    )
    return F.when(F.size(lengths) <= _CHUNK, within).otherwise(chunked)


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, r"[^0-9]", "")
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(found, F.lit(_IP))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    # Luhn: from the right, every second digit doubled, its digits added.
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), n - 1), F.lit(0),
        lambda a, i: a + F.when(i % 2 == 0, value(i)).otherwise(2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)),
    )
    return F.when((n >= 12) & (n <= 19), total % 10 == 0).otherwise(False)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base``: spans (start, order, end, found) of the four kinds, by start, then kind as listed.

    Code points, end exclusive; leftmost matches without overlap for each kind; matches that fail
    the kind's check are dropped without a retry. Null text has none. A column named _base is
    replaced; no other name clashes.
    """
    own = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # A cheap look first: most texts lack what a kind needs.
    some = {"email": F.contains("body", F.lit("@")), "phone": F.contains("body", F.lit("+"))}
    for kind in KINDS:
        found = F.regexp_extract_all("body", F.lit(PATTERNS[kind]), F.lit(0))
        gaps = F.split("body", PATTERNS[kind], -1)
        own = own.withColumn(kind, F.when(some.get(kind, F.lit(True)) & F.rlike("body", F.lit(GATES[kind])), F.struct(found.alias("found"), gaps.alias("gaps"))))
    spans = []
    for order, kind in enumerate(KINDS):
        found, gaps = F.col(f"{kind}.found"), F.col(f"{kind}.gaps")
        ends = _ends(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda f, g: (F.length(f) + F.length(g)).cast("bigint")))
        rows = F.zip_with(found, ends, lambda f, e: F.struct((e - F.length(f)).alias("start"), F.lit(order).alias("order"), e.alias("end"), f.alias("found")))
        rows = F.filter(rows, lambda x: _valid(kind, x["found"]))
        spans.append(F.coalesce(rows, F.array().cast("array<struct<start:bigint,order:int,end:bigint,found:string>>")))
    out = own.select("doc", F.array_sort(F.concat(*spans)).alias("_base"))
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != "_base"], "_base")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, (*KINDS, "term")))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(kinds, s["order"] + 1).alias("kind")))


def words_of(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != ""), F.lower)


def _placed(text: Column) -> Column:
    """The words of a text with their places: struct(term, start, end)."""
    word = r"\p{L}+"
    found, gaps = F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.split(text, word, -1)
    ends = _ends(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda f, g: (F.length(f) + F.length(g)).cast("bigint")))
    return F.zip_with(found, ends, lambda f, e: F.struct(F.lower(f).alias("term"), (e - F.length(f)).alias("start"), e.alias("end")))


def _groups(mentions: DataFrame) -> DataFrame:
    """``key, entity, n_entity`` of ``mentions`` (key, copies, entity).

    Entities of the very same texts share all counts, so they become one: a text with many of
    its own costs its words once. Two sums of hashes stand for a set of texts.
    """
    own = mentions.distinct()
    of = own.groupBy("entity").agg(F.sum("copies").alias("n_entity"), *[F.sum(F.xxhash64(F.lit(k), "key").cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)])
    return own.select("key", "entity").join(of, "entity").select("key", F.unhex(F.md5(F.concat_ws(" ", "s0", "s1", "n_entity"))).alias("entity"), "n_entity").distinct()


def disclosing_terms(met: DataFrame, words: DataFrame, n_docs: Column, share: float = SHARE, doubt: float = DOUBT) -> DataFrame:
    """``entity, term, sure`` where the term gives away at least ``share`` of the entity's information.

    With p over the documents of the corpus, the information content of an entity is -log p(e)
    and what a term discloses of it is log(p(e|t) / p(e)). Every pair that meets in a document
    counts, once is enough. Counts of entities, pairs and terms cover all documents, a text
    counting once for each of its ``copies``, and are summed before each shuffle. ``sure``: the
    term stands elsewhere too, and it still holds with p(e|t) lowered to its Wilson bound at
    ``doubt`` standard errors, copies of a text not counting as further evidence for the pair.
    """
    both = met.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("n_texts"), F.first("n_entity").alias("n_entity"))
    known = both.join(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")), "term")
    n = F.col("n_texts") + F.col("n_term") - F.col("n_both")
    p = F.col("n_texts") / n
    low = (p + doubt**2 / (2 * n) - doubt * F.sqrt(p * (1 - p) / n + doubt**2 / (4 * n * n))) / (1 + doubt**2 / n)
    content = -F.log(F.col("n_entity") / n_docs)
    told = lambda q: F.log(q) + content >= share * content
    return known.where((content > 0) & told(F.col("n_both") / F.col("n_term"))).select("entity", "term", ((F.col("n_both") < F.col("n_term")) & F.coalesce(told(F.nullif(low, F.lit(0.0))), F.lit(False))).alias("sure"))


def found_spans(docs: DataFrame, share: float = SHARE, doubt: float = DOUBT) -> DataFrame:
    """``key, base, spans`` of each distinct text that has any; ``key`` is its ``text_key``.

    Spans are (start, end, kind), kind "term" for disclosing terms. Protected entities are the
    distinct base matches. A term is marked wherever it stands in a document of an entity that it
    discloses, and where it surely does (``disclosing_terms``) in any other document; single
    letters never. What a term discloses is learned from all documents. Of the texts, only those
    with spans are shuffled, and counts of words.
    """
    found = base_spans(docs.select("text")).where(F.size("_base") > 0).select(text_key(F.col("text")).alias("key"), "text", F.col("_base").alias("m"))
    found = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"), F.first("m").alias("m")), "mentions")
    one = found.select("key", "copies", F.inline("m"))
    groups = written(_groups(one.select("key", "copies", F.unhex(F.md5(F.concat_ws(":", "order", F.lower("found")))).alias("entity"))), "entities")
    own = found.select("key", "copies", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).where(F.length("term") > 1)
    met = own.join(groups, "key")
    words = docs.select(F.explode(F.array_distinct(words_of(F.coalesce("text", F.lit(""))))).alias("term"))
    told = written(disclosing_terms(met, words, docs.agg(F.count(F.lit(1))).scalar(), share, doubt), "disclosing")
    hit = met.join(told, ["entity", "term"]).select("key", "term")
    sure = told.where("sure").select("term").distinct()
    if sure.isEmpty():
        hit, texts = hit.distinct(), found.select("key", "text")
    else:
        each = docs.where("text is not null").select(text_key(F.col("text")).alias("key"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("term"))
        some = marked(each.withColumn("h", F.xxhash64("term")), sure.select(F.xxhash64("term").alias("h"))).where("_maybe")
        others = written(some.join(sure, "term").select("key", "term").distinct(), "others")
        fresh = others.select("key").distinct().join(found.select("key"), "key", "left_anti")
        held = marked(docs.select(text_key(F.col("text")).alias("key"), "text").withColumn("h", short(F.col("key"))), fresh.select(short(F.col("key")).alias("h"))).where("_maybe")
        held = held.join(fresh, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        hit, texts = hit.unionByName(others).distinct(), written(found.select("key", "text").unionByName(held.select("key", "text")), "texts")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = texts.repartition(width, "key").select("key", F.explode(_placed(F.col("text"))).alias("t")).select("key", "t.*")
    at = placed.join(hit, ["key", "term"]).select("key", "start", "end")
    extra = at.groupBy("key").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("order"), "end")).alias("extra"))
    bare = F.transform("m", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint>>")
    out = found.select("key", bare.alias("base")).join(extra, "key", "full").select("key", F.coalesce("base", none).alias("base"), F.coalesce("extra", none).alias("extra"))
    outside = F.filter("extra", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return out.select("key", _named(F.col("base")).alias("base"), _named(F.array_sort(F.concat("base", outside))).alias("spans"))


def protected_spans(docs: DataFrame, share: float = SHARE, doubt: float = DOUBT) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans`` of ``found_spans``; [] for texts without any, null ones too.

    Every row stays, repeated ones too; other columns pass through, whatever their names, but
    columns named _base and _spans are replaced. An empty table gives no rows; texts of any
    length are taken whole. Only texts that may have spans, by a filter that is broadcast, are
    shuffled.
    """
    with scratch() as keep:
        spans = keep(written(found_spans(docs, share, doubt), "spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    keyed = docs.select(F.struct("*").alias("doc"), text_key(F.col("text")).alias("key")).withColumn("h", short(F.col("key")))
    keyed = marked(keyed, spans.select(short(F.col("key")).alias("h")))
    rest = keyed.where("not _maybe").select("doc", none.alias("base"), none.alias("spans"))
    some = keyed.where("_maybe").join(spans, "key", "left").select("doc", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
    columns = [F.col("doc")[c].alias(c) for c in docs.columns if c not in ("_base", "_spans")]
    return rest.unionByName(some).withColumnsRenamed({"base": "_base", "spans": "_spans"}).select(*columns, "_base", "_spans")


def sanitised(docs: DataFrame, share: float = SHARE, doubt: float = DOUBT) -> DataFrame:
    """``docs`` with every span of ``text`` generalised to its kind, such as ``[EMAIL]``.

    Overlapping spans become one, named by the first. Null text stays null. Columns and rows as
    in ``docs``, clashing names included.
    """
    out = protected_spans(docs.select("text", F.struct("*").alias("doc")), share, doubt)
    # Merged spans as pieces: text between them and the placeholder.
    step = lambda acc, s: F.struct(
        F.when(s["start"] < acc["upto"], acc["out"])
        .otherwise(F.concat(acc["out"], F.array(F.substring(F.col("text"), (acc["upto"] + 1).cast("int"), (s["start"] - acc["upto"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))
        .alias("out"),
        F.greatest(acc["upto"], s["end"]).alias("upto"),
    )
    pieces = F.aggregate("_spans", F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("upto")), step)
    rest = lambda p: F.array_join(F.concat(p["out"], F.array(F.substring(F.col("text"), (p["upto"] + 1).cast("int"), F.length("text")))), "")
    clean = F.when(F.size("_spans") > 0, rest(pieces)).otherwise(F.col("text"))
    return out.select("doc", clean.alias("clean")).select(*[F.col("clean").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
