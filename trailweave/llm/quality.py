"""Document quality by Bradley-Terry ranking: logistic loss on feature differences of pairs."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import shipped
from trailweave.llm.texts import sliced, utf8

#: Rows of either label that the fit may take, by the order of a hash of doc_id.
SAMPLE = 4000
#: Score from which a document counts as good.
LEAST = 0.7
_CLASS = np.full(256, 5, np.int8)  # 0 lower, 1 upper, 2 digit, 3 white space, 4 usual marks, 5 other marks, 6 beyond ASCII
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()-")):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
_CLASS[128:] = 6
FEATURES = ("upper", "digit", "usual marks", "other marks", "white", "word length", "long words", "distinct words", "repeated lines", "line length", "words", "marks at ends", "sentences", "bare", "pairs again", "short")


def features(text: bytes) -> np.ndarray:
    """What a text looks like, as numbers between about -3 and 3; no text at all: zeros but for its length."""
    n = len(text)
    words = text.split()
    out = np.zeros(len(FEATURES))
    out[10] = np.log1p(len(words)) / 3
    if not words:
        out[13] = out[15] = 1.0
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=counts, minlength=7) / n
    out[0:5] = by[1], by[2], by[4], by[5], by[3]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out[5] = min(3.0, sizes.mean() / 6)
    out[6] = (sizes > 18).mean()
    out[7] = len(set(words)) / len(words) ** 0.85
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[8] = 1 - len(set(lines)) / len(lines)
    out[9] = min(3.0, np.log1p(n / len(lines)) / 3)
    out[11] = sum(w[-1:] in b"!#$%&*|~=+<>{}[]\\^_" for w in words) / len(words)
    out[12] = sum(w[-1:] in b".?" for w in words) / len(words)
    out[13] = float(len(words) < 8)
    out[14] = 1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    out[15] = 1 / len(words) ** 0.5
    return out


@dataclass(frozen=True)
class Model:
    """Centre and spread of the features, their weights, and the line from utility to score."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float  # utility that gets the score ``least``
    unit: float
    least: float = LEAST

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = _expanded((x - self.centre) / self.spread) @ self.weights
        z = np.clip((z - self.cut) / self.unit, -30, 30) + np.log(self.least / (1 - self.least))
        return np.clip(1 / (1 + np.exp(-z)), 0.0, 1.0)


def _expanded(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -4, 4)
    return np.concatenate([z, z * z, np.abs(z)], axis=-1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, pairs: int = 20_000, seed: int = 7, least: float = LEAST) -> Model:
    """Learns utilities from pairs of a good and a bad document.

    P(good over bad) = sigmoid(w . (f(good) - f(bad))); the loss is its negative logarithm with
    a small square penalty, lowered by full-gradient steps with momentum over seeded pairs. The
    cut is the utility quantile of the labelled documents that errs least on them; of several
    such the mean, where it errs as little, else the lowest. Without a pair nothing can be learned: every
    score is 0.5 if all labels are bad, else 0.9, so that nothing is rejected without a reason.
    """
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    if not len(good) or not len(bad):
        k = x.shape[1] if x.ndim == 2 else len(FEATURES)
        score = 0.9 if len(good) or not len(bad) else 0.5
        return Model(np.zeros(k), np.ones(k), np.zeros(3 * k), float(np.log(least / (1 - least)) - np.log(score / (1 - score))), 1.0, least)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    f = _expanded((x - centre) / spread)
    rng = np.random.default_rng(seed)
    d = f[rng.choice(good, pairs)] - f[rng.choice(bad, pairs)]
    w, speed = np.zeros(f.shape[1]), np.zeros(f.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        speed = 0.9 * speed + 0.05 * (d.T @ p / len(d) - 1e-3 * w)
        w = w + speed
    u = f @ w
    order = np.sort(u)
    cuts = np.unique(np.concatenate([order[:1] - 1e-6, (order[1:] + order[:-1]) / 2]))
    su, sl = np.sort(u[good]), np.sort(u[bad])
    errors = np.searchsorted(su, cuts) + (len(sl) - np.searchsorted(sl, cuts))
    cut = float(cuts[np.nonzero(errors == errors.min())[0]].mean())
    if not errors.min() == (np.searchsorted(su, cut) + len(sl) - np.searchsorted(sl, cut)):
        cut = float(cuts[int(errors.argmin())])
    return Model(centre, spread, w, cut, max(1e-6, float(u.std()) / 2), least)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 2, folds: int = 4) -> DataFrame:
    """At most ``sample`` rows of either label outside fold ``fold``: ``doc_id, text, y``.

    A documented bound for the fit only. Rows are taken in the order of a hash of doc_id, so the
    choice is the same for any partitioning. Labels that are null, or that differ for one
    document, are left out; so are documents without an id. Of rows that share a doc_id, the
    least text counts, so the bound holds whatever ``docs`` repeats.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("most"))
    known = known.where((F.col("y") == F.col("most")) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> Model:
    """The model of ``training_rows``; only their features, a bounded table, reach the driver."""
    shipped(docs.sparkSession)

    def rows(batches):
        for batch in sliced(batches):
            x = [features(t).tolist() for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y").cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    found = training_rows(docs, labels, sample).select("doc_id", "y", "text").mapInArrow(rows, "doc_id bigint, y bigint, x array<double>").toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), least=least)
    x = np.array(found.column("x").to_pylist())
    order = np.lexsort((*x.T, found.column("doc_id").to_numpy()))
    return fit(x[order], found.column("y").to_numpy()[order], least=least)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and score (double, 0 to 1) by the text alone; null text is ''.

    Row by row in Arrow batches; a column named score is replaced.
    """
    shipped(docs.sparkSession)
    keep = [c for c in docs.columns if c != "score"]

    def run(batches):
        for batch in sliced(batches):
            x = [features(t) for t in utf8(batch)]
            s = model.scores(np.array(x).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s, pa.float64())], names=[*keep, "score"])

    rows = docs.select(*keep)
    return rows.mapInArrow(run, rows.withColumn("score", F.lit(0.0)).schema)


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST, fold: int = 2, folds: int = 4) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null doc_id is held out.

    Whole texts are scored, of any length; null ones as ''. Repeated rows stay repeated and score
    alike; other columns are left out; without documents or labels see ``fit``.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(True))
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learned(docs, labels, sample, least))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def crc_fold(doc_id: int, folds: int = 4) -> int:
    """The fold of a document, as ``training_rows`` computes it."""
    return zlib.crc32(str(doc_id).encode()) % folds


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, unchanged, in one pass over the texts."""
    shipped(docs.sparkSession)
    model = learned(docs, labels, sample, least)

    def run(batches):
        for batch in sliced(batches):
            s = model.scores(np.array([features(t) for t in utf8(batch)]).reshape(-1, len(FEATURES)))
            yield batch.filter(pa.array(s >= least))

    return docs.mapInArrow(run, docs.schema)
