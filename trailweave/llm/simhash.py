"""SimHash near-duplicates, found by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import scratch, shipped, written
from trailweave.llm.texts import one_of_each, sliced, text_key, utf8
from trailweave.operators.components import connected_components

SEED, SHINGLE, MAX_BITS = 42, 3, 3


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED, step: int = 65_536) -> int:
    """The SimHash of UTF-8 text, unsigned: each bit set in over half the shingles' XXH64.

    ``step`` shingles are hashed at a time, so that a long text costs little memory.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts, join, digest = np.zeros(64, np.int64), b" ".join, xxhash.xxh64_intdigest
    for at in range(0, n, step):
        own = words[at : min(n, at + step) + shingle - 1]
        shingles = zip(*(own[k:] for k in range(shingle))) if len(words) >= shingle else [own]
        h = np.fromiter((digest(join(x), seed) for x in shingles), ">u8", min(step, n - at))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def set_fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles' hashes, unsigned; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 65_536):
        own = found[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(own, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(found)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, h, fp`` of every row: id, digest of the text, and the SimHash as a bigint of the same bits.

    Null text has no words, so fp 0.
    """
    shipped(docs.sparkSession)

    def hashed(batches):
        for batch in sliced(batches):
            found = np.fromiter((fingerprint(x, shingle, seed) for x in utf8(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found.view(np.int64))], names=["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("h"), "text").mapInArrow(hashed, "doc_id bigint, h binary, fp bigint")


def _ball(segment: Column, bits: int) -> Column:
    """All values within one bit of a segment."""
    return F.concat(F.array(segment), F.transform(F.array(*[F.lit(1 << k) for k in range(bits)]).cast("array<bigint>"), lambda m: segment.bitwiseXOR(m)))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` (a < b): every pair of distinct fingerprints at ``max_bits`` or fewer differing bits.

    Two segments of 32 bits: if a pair differs in at most 3 bits, one segment differs in at most
    one. Each fingerprint asks for the 33 values of that ball in each segment; tables hold each
    fingerprint's own two. Whole distances are verified inside the join, so only links leave it.
    Fingerprints are dealt to all tasks before they are expanded.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of one bit find up to 3 differing bits")
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)
    own = F.array(F.struct(F.lit(0).alias("seg"), low.alias("key")), F.struct(F.lit(1).alias("seg"), high.alias("key")))
    near = F.array_union(
        F.transform(_ball(low, 32), lambda x: F.struct(F.lit(0).alias("seg"), x.alias("key"))),
        F.transform(_ball(high, 32), lambda x: F.struct(F.lit(1).alias("seg"), x.alias("key"))),
    )
    asked = fps.select(F.col("fp").alias("a"), F.inline(near))
    table = fps.select(F.col("fp").alias("b"), F.inline(own))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return asked.join(table, (asked.seg == table.seg) & (asked.key == table.key) & (F.col("a") < F.col("b")) & (apart <= max_bits)).select("a", "b").distinct()


def _grouped(docs: DataFrame, max_bits: int, shingle: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(known: doc_id, h, fp of every row; of: fp, least, component of every fingerprint)."""
    with scratch() as keep:
        known = keep(written(fingerprints(docs, shingle, seed), "fingerprints"))
        nodes = written(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
        found = connected_components(links(nodes.select("fp"), max_bits))
        of = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
        of = keep(written(of, "members"))
    return known, of


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` of every row.

    Component: all documents reachable by links; its id is the smallest doc_id in it. Equal
    fingerprints are one node, so exact copies cost one row each and no pairs. kept: doc_id is
    the component's id. A null doc_id never names a component that has another; repeated rows
    stay repeated; texts are hashed whole; other columns are left out. Empty table: no rows.
    """
    known, of = _grouped(docs, max_bits, shingle, seed)
    named = of.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = of.join(named, "component").select("fp", "component_id")
    return known.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def deduplicated(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of each group, as ``texts.one_of_each``: that of its smallest doc_id and text digest.

    Different texts under one doc_id are different documents.
    """
    known, of = _grouped(docs.where("doc_id is not null"), max_bits, shingle, seed)
    return one_of_each(docs, known.join(of, "fp").select("doc_id", "h", "component"))
