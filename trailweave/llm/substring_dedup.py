"""Substring dedup: windows repeated at one length are extended to twice that length."""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import dropped, released, scratch, shipped, written
from trailweave.llm.texts import sliced, utf8
from trailweave.llm.prefilter import marked

WINDOW = 35


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order (wraps at 64 bits)."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + (b >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` neighbours, by doubling."""
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def levels(window: int) -> tuple[int, int, int]:
    """Lengths of the three levels: about a quarter, a half and the whole of a window."""
    half = -(-window // 2)
    return -(-half // 2), half, window


class Hashes:
    """Hashes of all windows of a text's words at each level; a longer one joins two of half its length."""

    def __init__(self, words: list[bytes], window: int = WINDOW, seed: int = 0):
        base, half, _ = levels(window)
        now, size = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words)), 1
        for to in (*(1 << k for k in range(1, base.bit_length()) if 1 << k < base), base, half, window):
            if to > size:
                now, size = _mixed(now[: len(now) - (to - size)], now[to - size :]), to
            if size == base:
                self.base = now
            if size == half:
                self.half = now
        self.whole = now


class Anchors:
    """Positions whose base window has the least hash of all in some whole window.

    Equal windows have the same anchors at the same places in them, so a window can only be
    repeated if its anchors are; on usual texts they are one position in a dozen.
    """

    def __init__(self, hashes: Hashes, window: int = WINDOW):
        base, half, _ = levels(window)
        self.reach = window - base + 1  # base windows in a whole one
        self.low = _least(hashes.base, self.reach)  # by start of the whole window
        n = len(hashes.base)
        padded = np.concatenate([np.zeros(self.reach - 1, np.uint64), self.low, np.zeros(self.reach - 1, np.uint64)])
        self.at = np.flatnonzero(~_least(~padded, self.reach)[:n] == hashes.base)
        self.base = hashes.base[self.at]
        # The half windows that start and that end with the base window, where they exist.
        last = len(hashes.half) - 1
        self.ahead = np.where(self.at <= last, hashes.half[np.minimum(self.at, last)], 0)
        back = self.at + base - half
        self.back = np.where((back >= 0) & (back <= last), hashes.half[np.clip(back, 0, last)], 0)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """``h, doc_id, text``: h is a hash of both, by which passes find a row again."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text")


def _maybe(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose h may be one of ``wanted``'s: all that are, and some that aren't."""
    return marked(rows, wanted).where("_maybe").drop("_maybe")


def _first_pass(docs: DataFrame, window: int) -> DataFrame:
    """For each row: digest of its text, words, digest of all words kept, and its anchors."""

    def scan(batches):
        kind = pa.list_(pa.struct([("at", pa.int32()), ("base", pa.int64()), ("ahead", pa.int64()), ("back", pa.int64())]))
        for batch in sliced(batches):
            key, n, kept, anchors = [], [], [], []
            for text in utf8(batch):
                words = text.split()
                key.append(hashlib.sha256(text).digest()[:16])
                n.append(len(words))
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(Anchors(Hashes(words, window), window) if len(words) >= window else None)
            offsets = np.concatenate([[0], np.cumsum([0 if a is None else len(a.at) for a in anchors])]).astype(np.int32)
            some = [a for a in anchors if a is not None]
            joined = lambda name, own=some: np.concatenate([getattr(a, name) for a in own]) if own else np.zeros(0, np.uint64)
            values = pa.StructArray.from_arrays(
                [pa.array(joined("at").astype(np.int32)), *(pa.array(_signed(joined(x))) for x in ("base", "ahead", "back"))], names=["at", "base", "ahead", "back"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("doc_id"), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind)],
                names=["h", "doc_id", "key", "n_words", "all_sha256", "anchors"],
            )

    return _texts(docs).mapInArrow(scan, "h bigint, doc_id bigint, key binary, n_words bigint, all_sha256 string, anchors array<struct<at:int,base:bigint,ahead:bigint,back:bigint>>")


def _candidates(texts: DataFrame, window: int) -> DataFrame:
    """``row, at, hash, check`` of the whole windows whose anchors and half windows are all repeated.

    Two hashes of 64 bits from different seeds: only at this level a chance match would cost words.
    """

    def scan(batches):
        base, half, _ = levels(window)
        for batch in sliced(batches):
            keys, starts, hashes, checks = [], [], [], []
            for text, anchors in zip(utf8(batch), batch.column("anchors"), strict=True):
                words = text.split()
                whole = Hashes(words, window)
                low = _least(whole.base, window - base + 1)
                rows = anchors.values
                at, ahead, back = (rows.field(x).to_numpy(zero_copy_only=False) for x in ("at", "ahead", "back"))
                found = np.zeros(len(low), bool)
                for offset in range(window - base + 1):
                    # The half windows beside the anchor that lie inside the whole window are repeated too.
                    fits = (ahead | (offset > window - half)) & (back | (offset < half - base))
                    s = at[fits] - offset
                    p = at[fits][(s >= 0) & (s < len(low))]
                    s = p - offset
                    found[s[low[s] == whole.base[p]]] = True
                s = np.flatnonzero(found)
                keys.append(np.full(len(s), len(keys), np.int32))
                starts.append(s.astype(np.int32))
                hashes.append(whole.whole[s])
                checks.append(Hashes(words, window, 1).whole[s] if len(s) else whole.whole[:0])
            if not keys:
                continue
            index = pa.array(np.concatenate(keys))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(index), pa.array(np.concatenate(starts)), pa.array(_signed(np.concatenate(hashes))), pa.array(_signed(np.concatenate(checks)))], names=["row", "at", "hash", "check"])

    return texts.mapInArrow(scan, "row bigint, at int, hash bigint, check bigint")


def _repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """Values of ``columns`` in two rows or more; a value of a third of all rows is one row for each task.

    Written, so that a join with it starts from both sides' own shuffles and can split a hot value.
    """
    return written(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*columns), "repeated")


def _with_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (h, doc_id, key of the first pass, and more) with their texts."""
    digest = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 32))
    texts = _maybe(_texts(docs), rows).withColumnRenamed("doc_id", "_id")
    return texts.join(rows, "h").where(F.col("_id").eqNullSafe(F.col("doc_id")) & (digest == F.col("key")))


def removed_starts(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first, ones, starts): what the passes find, for ``without_repeats``.

    first: ``doc_id, key, n_words, all_sha256`` of each document, and more. ones: ``key, copies`` of each
    distinct text of a window or more. starts: for each text that stands alone and has repeated
    windows, ``h, doc_id, key, starts``. Exact copies are one text with a count: all their windows
    are repeated, and one of them stands for all. Levels: base windows at anchors, half windows
    beside the surviving anchors, whole windows. At each level a window survives if its hash is
    found twice; only hashes are counted, before any shuffle, and joined back to their places.
    """
    spark = docs.sparkSession
    shipped(spark)
    first = written(_first_pass(docs, window).withColumn("row", F.monotonically_increasing_id()), "anchors")
    long = first.where(F.col("n_words") >= window)
    ones = written(long.groupBy("key").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("copies")), "ones")
    one_of_each = written(long.select("row", "h", "doc_id", "key").join(ones, ["key", "h"]), "texts")
    places = _maybe(first.select("h", "row", "anchors"), one_of_each).select("row", F.inline("anchors"))
    base = _repeated(places, "base")
    level = written(places.join(base, "base").select("row", "at", "ahead", "back"), "level1")
    released(spark)
    half = _repeated(level.select(F.explode(F.array("ahead", "back")).alias("half")).where("half <> 0"), "half")
    ahead = level.join(half.select(F.col("half").alias("ahead"), F.lit(True).alias("a")), "ahead", "left")
    both = ahead.join(half.select(F.col("half").alias("back"), F.lit(True).alias("b")), "back", "left")
    anchor = F.struct("at", F.coalesce("a", F.lit(False)).alias("ahead"), F.coalesce("b", F.lit(False)).alias("back"))
    level2 = both.where("a or b").groupBy("row").agg(F.collect_list(anchor).alias("anchors"))
    level2 = written(level2.join(one_of_each, "row"), "level2")
    released(spark)
    dropped(level)
    windows = written(_candidates(_with_texts(docs, level2).select("row", "text", "anchors"), window), "windows")
    released(spark)
    again = windows.join(_repeated(windows, "hash", "check"), ["hash", "check"]).select("row", "at")
    starts = again.groupBy("row").agg(F.collect_set("at").alias("starts"))
    starts = written(starts.join(one_of_each.where("copies = 1").select("row", "h", "doc_id", "key"), "row").drop("row"), "starts")
    released(spark)
    dropped(windows)
    return first, ones, starts


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in any
    row, the same one included. Null text has no words. A repeated row is another document. The
    digest is of the kept words, joined by one space. Texts are processed whole, of any length;
    an empty table gives no rows; other columns are left out.
    """
    with scratch() as keep:
        first, ones, starts = removed_starts(docs, window)
        first, starts = keep(written(first.select("doc_id", "key", "n_words", "all_sha256"), "digests")), keep(starts)
        by_key = keep(written(ones.select("key", "copies").join(starts.select("key", F.lit(True).alias("cut")), "key", "left"), "found"))
    marked = first.join(by_key, "key", "left")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    nothing = hashlib.sha256(b"").hexdigest()
    plain = marked.where(copied | F.col("cut").isNull()).select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"), F.when(copied, nothing).otherwise(F.col("all_sha256")).alias("kept_sha256")
    )

    def cut(batches):
        for batch in sliced(batches):
            n, gone, kept = [], [], []
            for text, at in zip(utf8(batch), batch.column("starts"), strict=True):
                words = text.split()
                stay = _kept(len(words), at.values.to_numpy(), window)
                n.append(len(words))
                gone.append(len(words) - int(stay.sum()))
                kept.append(hashlib.sha256(b" ".join([words[k] for k in np.flatnonzero(stay).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = _with_texts(docs, starts).select("doc_id", "text", "starts")
    return plain.unionByName(own.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"))


def _kept(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words no window from ``starts`` covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:n] == 0
