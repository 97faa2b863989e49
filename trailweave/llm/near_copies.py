"""Near copies by the Jaccard similarity of word shingles: SimHash and, beyond its bits, MinHash bands propose pairs, exact sets decide."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import scratch, shipped, written
from trailweave.llm import simhash
from trailweave.llm.texts import one_of_each, short, sliced, text_key, utf8
from trailweave.operators.components import connected_components
from trailweave.llm.prefilter import marked

SEED, SHINGLE, LEAST = 42, 5, 0.8
#: A pair at similarity s meets in a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.999997 at 0.8.
BANDS, ROWS = 32, 5
#: Heads that a bucket's sets are held against before what is left is compared by differences; sets cost, not results.
ROUNDS = 2
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of UTF-8 text; a shorter text is one shingle, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(join(words[k : k + shingle]), SEED) for k in range(n)), np.uint64, n))


def set_key(found: np.ndarray) -> bytes:
    """A digest of 128 bits, which stands for the set."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def bands(found: np.ndarray, step: int = 2048) -> np.ndarray:
    """One hash for each band: of its number and the least of each of its permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), step):
        least = np.minimum(least, ((found[at : at + step, None] ^ _MASKS) * _FACTORS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)), np.uint64, BANDS)


def _hashed(docs: DataFrame) -> DataFrame:
    """``doc_id, h, key, n, fp, bands`` of every row; h is the text's digest, key that of its set of n shingles, fp the set's SimHash."""
    kind = pa.list_(pa.int64())

    def run(batches):
        for batch in sliced(batches):
            sets = [shingles(x) for x in utf8(batch)]
            own = pa.array([bands(s).view(np.int64) if len(s) else [] for s in sets], kind)
            fps = pa.array(np.fromiter(map(simhash.set_fingerprint, sets), np.uint64, len(sets)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(map(set_key, sets), pa.binary()), pa.array([len(s) for s in sets], pa.int32()), fps, own], names=["doc_id", "h", "key", "n", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("h"), "text")
    return rows.mapInArrow(run, "doc_id bigint, h binary, key binary, n int, fp bigint, bands array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, found``: the shingle sets of ``nodes`` (key, h), from one text each."""

    def run(batches):
        for batch in sliced(batches):
            sets = [shingles(x) for x in utf8(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "found"])

    keyed = docs.select(text_key(F.col("text")).alias("key"), "text").withColumn("h", short(F.col("key")))
    rows = marked(keyed, nodes.select(short(F.col("h")).alias("h"))).where("_maybe").select(F.col("key").alias("h"), "text")
    texts = rows.join(nodes.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    return texts.select("text").mapInArrow(run, "key binary, found array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets' Jaccard similarity is ``least`` or more."""
    both = pairs.join(sets.toDF("a", "_fa"), "a").join(sets.toDF("b", "_fb"), "b")
    shared = F.size(F.array_intersect("_fa", "_fb"))
    return both.where(shared >= least * (F.size("_fa") + F.size("_fb") - shared)).select("a", "b")


def _close(x, y, least: float):
    """Sizes that allow the similarity."""
    return F.least(x, y) >= least * F.greatest(x, y)


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """``a, b``: sets of one fingerprint with its least set, and the least sets of fingerprints that ``simhash.links`` finds."""
    heads = written(nodes.where("n > 0").groupBy("fp").agg(F.min("key").alias("head")), "fingerprints")
    same = nodes.where("n > 0").join(heads, "fp").where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    near = simhash.links(heads.select("fp"))
    near = near.join(heads.toDF("a", "_ka"), "a").join(heads.toDF("b", "_kb"), "b").select(F.col("_ka").alias("a"), F.col("_kb").alias("b"))
    return same.unionByName(near)


def _headed(members: DataFrame) -> DataFrame:
    """``members`` (bucket, key, n, weight) with their bucket's head and head_n: the set that meets most others in all its buckets."""
    heads = members.groupBy("bucket").agg(F.max_by(F.struct("key", "n"), F.struct("weight", "key")).alias("head"))
    return members.join(heads.select("bucket", F.col("head.key").alias("head"), F.col("head.n").alias("head_n")), "bucket")


def _with_components(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the component of their key."""
    return members.join(connected_components(links).toDF("key", "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def _by_differences(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``a, b``: of the rows of each head in ``open_`` (head, head_n, key, n, component) all pairs across components that can be at ``least``.

    D is what a set and its head p differ in, d its size. Two sets x and y are linked only if
    their difference is at most t(|x| + |y|), t = (1 - least) / (1 + least), so only if the two D
    share (d_x + d_y - t(|x| + |y|)) / 2 elements. Sets linked with the head are of one component,
    so one of the two is not, its d over t(|y| + |p|); that leaves a least overlap for each set
    alone, and sets that share so much share one of the first elements of their D in any order.
    New elements come before missing ones: copies edited each for itself share none, so a group of
    them makes few pairs where a bucket would make its square. No link is lost.
    """
    t = (1 - least) / (1 + least)
    both = open_.join(sets.toDF("key", "_f"), "key").join(sets.toDF("head", "_p"), "head")
    new, gone = F.array_except("_f", "_p"), F.array_except("_p", "_f")
    own = both.select("head", "head_n", "key", "n", "component", F.concat(new, gone).alias("own"), (F.col("n") - F.size(new)).alias("shared"))
    own = own.withColumn("d", F.size("own")).withColumn("far", ~(F.col("shared") >= least * (F.col("n") + F.col("head_n") - F.col("shared"))))
    first = F.col("d") - F.ceil((F.col("d") - t * F.col("n") + t * F.col("head_n")) / 2 - 1e-9) + 1
    deep = F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("d") - t * F.col("n") - t * F.col("head_n")) / 2 - 1e-9)) + 1
    own = own.withColumn("first", first.cast("int")).withColumn("deep", F.when(F.col("far"), deep.cast("int")).otherwise(F.col("first")))
    own = written(own.select("head", "key", "n", "component", "d", "far", "first", F.slice("own", F.lit(1), F.greatest(F.col("first"), F.col("deep"))).alias("own")), "differences")
    rows = own.select("head", "key", "n", "component", "d", "far", "first", F.posexplode("own").alias("at", "element")).withColumn("place", F.xxhash64("head", "element")).drop("head", "element")
    x, y = rows.where("at < first").alias("x"), rows.where("far").alias("y")
    once = ~F.col("x.far") | ((F.col("y.at") < F.col("y.first")) & (F.col("x.key") < F.col("y.key")))
    shared = F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at"))
    enough = 2 * shared >= F.col("x.d") + F.col("y.d") - t * (F.col("x.n") + F.col("y.n")) - 1e-9
    met = (F.col("x.place") == F.col("y.place")) & (F.col("x.component") != F.col("y.component")) & once & _close(F.col("x.n"), F.col("y.n"), least) & enough
    return x.join(y, met).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def _grouped(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(known: doc_id, h, key of every row; named: key, least, component of every set)."""
    shipped(docs.sparkSession)
    with scratch() as keep:
        known = keep(written(_hashed(docs), "shingles"))
        nodes = written(known.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("h").alias("h"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "sets")
        rows = nodes.select("key", "n", F.explode("bands").alias("bucket"))
        shared = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets")
        members = written(marked(rows, shared.select("bucket"), "bucket").where("_maybe").select("key", "n", "bucket").join(shared, "bucket"), "members")
        members = written(members.select("bucket", "key", "n").join(members.groupBy("key").agg(F.sum("c").alias("weight")), "key"), "weighted")
        proposed = written(_by_simhash(nodes.select("key", "n", "fp")), "proposed")
        wanted = members.select("key").union(proposed.select("a")).union(proposed.select("b")).distinct()
        wanted = written(nodes.join(wanted, "key", "left_semi").select("key", "h"), "wanted")
        sets = written(_sets(docs, wanted), "found")
        links = written(_alike(proposed, sets, least), "links")
        cells = rest = written(_headed(members), "headed")
        for k in range(ROUNDS):
            pairs = rest.where((F.col("key") != F.col("head")) & _close(F.col("n"), F.col("head_n"), least)).select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
            links = written(links.unionByName(_alike(pairs, sets, least)).distinct(), "links")
            of = written(_with_components(cells, links), "grouped")
            if k + 1 < ROUNDS:
                near = of.where("key = head").select("bucket", F.col("component").alias("_near"))
                rest = _headed(of.join(near, "bucket").where("component <> _near").select("bucket", "key", "n", "weight"))
        others = of.where("key <> head")
        mixed = others.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("bucket")
        open_ = others.join(mixed, "bucket", "left_semi").select("head", "head_n", "key", "n", "component").distinct()
        found = connected_components(links.unionByName(_alike(_by_differences(open_, sets, least), sets, least)))
        named = keep(written(nodes.join(found, nodes.key == found.node, "left").select("key", "least", F.coalesce("component", "key").alias("component")), "named"))
    return known, named


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, component_id, kept`` of every row, as in ``simhash.near_duplicates``.

    Linked: texts whose sets of 5-word shingles have a Jaccard similarity of ``least`` or more and
    whose SimHash is within 3 bits, found by multi-index hashing, or that share a band of MinHash
    values, as 3 bits reach few edited copies. Equal sets are one node. Within a bucket all nodes
    are held against a head, what isn't linked with it against another; where a bucket still holds
    several components, ``_by_differences`` finds their links, so a group of copies doesn't cost
    its square. Null text has no words; texts without words are alike; an empty table gives no
    rows; other columns are left out.
    """
    known, named = _grouped(docs, least)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return known.select("doc_id", "key").join(named.join(ids, "component").select("key", "component_id"), "key").select("doc_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each group, as ``texts.one_of_each``: that of its smallest doc_id and text digest.

    Different texts under one doc_id are different documents.
    """
    known, named = _grouped(docs.where("doc_id is not null"), least)
    return one_of_each(docs, known.join(named, "key").select("doc_id", "h", "component"))
