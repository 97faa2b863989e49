"""Benchmark decontamination with a generalised suffix automaton over test items' words."""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import shipped, written
from trailweave.llm.texts import sliced, utf8

WINDOW = 13
#: A document counts as contaminated when at least one in so many of its words is hit.
COVERAGE = 20
#: Bytes of test items in one automaton, which is built once and broadcast: more items go in more blocks.
BLOCK_BYTES = 8_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased: runs of digits, a-z and all beyond ASCII."""
    return _WORD.findall(text.translate(_LOWER))


class Automaton:
    """Suffix automaton of all items' word sequences; each state knows the windows that end in it.

    Arrays hold it: a state with one transition has its word and target in two of them, one with
    several a range of sorted words. An 8 MB block of items takes about 100 MB, twice that while
    it is built, and pickles as it is.
    """

    def __init__(self, items: Iterable[tuple[str, Sequence[bytes]]], window: int = WINDOW):
        self.window, self.words, self.items = window, {}, []
        self.word, self.to, self.link, self.length = array("i", [0]), array("i", [0]), array("i", [-1]), array("i", [0])
        self._many: dict[int, dict[int, int]] = {}
        numbers: dict[str, int] = {}
        ends, of, sizes = array("i"), array("i"), array("i")  # state of a prefix, item, words of its window
        shortest = window
        for item, words in items:
            last, n = 0, len(words)
            if not n:
                continue
            shortest = min(shortest, n)
            number = numbers.setdefault(item, len(numbers))
            for k, w in enumerate(words):
                last = self._extend(last, self.words.setdefault(w, len(self.words) + 1))
                if k + 1 >= min(window, n):
                    ends.append(last)
                    of.append(number)
                    sizes.append(min(window, n))
        self.items, self.shortest = list(numbers), shortest
        self._pack()
        self._windows(ends, of, sizes)

    def _get(self, state: int, w: int) -> int:
        """The state after a word; 0: none."""
        own = self._many.get(state)
        if own is not None:
            return own.get(w, 0)
        return self.to[state] if self.word[state] == w else 0

    def _set(self, state: int, w: int, to: int) -> None:
        own = self._many.get(state)
        if own is not None:
            own[w] = to
        elif self.word[state] in (0, w):
            self.word[state], self.to[state] = w, to
        else:
            self._many[state] = {self.word[state]: self.to[state], w: to}

    def _extend(self, last: int, w: int) -> int:
        link, length = self.link, self.length
        old = self._get(last, w)
        if old:
            return old if length[old] == length[last] + 1 else self._clone(last, w, old)
        own = self._state(length[last] + 1, 0)
        while last >= 0 and not (old := self._get(last, w)):
            self._set(last, w, own)
            last = link[last]
        if last >= 0:
            link[own] = old if length[old] == length[last] + 1 else self._clone(last, w, old)
        return own

    def _state(self, length: int, link: int) -> int:
        for a, x in ((self.word, 0), (self.to, 0), (self.length, length), (self.link, link)):
            a.append(x)
        return len(self.word) - 1

    def _clone(self, last: int, w: int, old: int) -> int:
        own = self._state(self.length[last] + 1, self.link[old])
        if old in self._many:
            self._many[own] = dict(self._many[old])
        self.word[own], self.to[own] = self.word[old], self.to[old]
        self.link[old] = own
        while last >= 0 and self._get(last, w) == old:
            self._set(last, w, own)
            last = self.link[last]
        return own

    def _pack(self) -> None:
        """Sorted ranges for the states with several transitions: word -k-1 stands for range k."""
        self.first, self.range_word, self.range_to = array("i", [0]), array("i"), array("i")
        for k, state in enumerate(sorted(self._many)):
            own = self._many[state]
            self.word[state] = -k - 1
            for w in sorted(own):
                self.range_word.append(w)
                self.range_to.append(own[w])
            self.first.append(len(self.range_word))
        del self._many

    def _windows(self, ends: array, of: array, sizes: array) -> None:
        """Windows by state, the highest on the suffix links that still is one; and for each state the
        nearest on its links, itself included, that has windows."""
        for k, state in enumerate(ends):
            while self.link[state] > 0 and self.length[self.link[state]] >= sizes[k]:
                state = self.link[state]
            ends[k] = state
        rows = np.unique(np.array([ends, sizes, of], np.int32).reshape(3, -1), axis=1)
        self.found_size, self.found_item = array("i", rows[1].tobytes()), array("i", rows[2].tobytes())
        self.found_first = array("i", np.searchsorted(rows[0], np.arange(len(self.word) + 1)).astype(np.int32).tobytes())
        near = np.arange(len(self.word), dtype=np.int32)
        none, link = np.diff(np.frombuffer(self.found_first, np.int32)) == 0, np.frombuffer(self.link, np.int32)
        near[none] = np.maximum(link[none], 0)
        while True:  # pointer doubling over states without windows
            after = near[near]
            if (after == near).all():
                break
            near = after
        near[none[near]] = 0
        self.near = array("i", near.tobytes())

    def matches(self, ids: Sequence[int]) -> Iterator[tuple[int, int, int]]:
        """Streams word numbers; (end, window's words, item) for every window that ends at a word."""
        word, to, link, length, near = self.word, self.to, self.link, self.length, self.near
        first, range_word, range_to, found, size_of, item_of = self.first, self.range_word, self.range_to, self.found_first, self.found_size, self.found_item
        state = size = 0
        for k, w in enumerate(ids):
            while True:
                own = word[state]
                after = to[state] if own == w else 0
                if own < 0:
                    end = first[-own]
                    at = bisect_left(range_word, w, first[-own - 1], end)
                    after = range_to[at] if at < end and range_word[at] == w else 0
                if after or not state:
                    break
                state = link[state]
                size = length[state]
            if not after:
                continue
            state, size = after, size + 1
            at = near[state]
            while at:
                for x in range(found[at], found[at + 1]):
                    if size_of[x] <= size:
                        yield k + 1, size_of[x], item_of[x]
                at = near[link[at]]

    def hits(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words (end exclusive) and the items with occurring windows.

        Only runs of known words that are long enough for the shortest window are streamed.
        """
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids != 0, [False]]).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for lo, hi in edges.reshape(-1, 2)[(edges[1::2] - edges[::2]) >= self.shortest].tolist():
            for end, n, own in self.matches(ids[lo:hi].tolist()):
                a, b = lo + end - n, lo + end
                items.add(own)
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, b))
        return spans, {self.items[k] for k in items}


def _automata(items: DataFrame, window: int, block_bytes: int) -> Iterator[Automaton]:
    """Automata of blocks of items, read in order of id through the driver, one block at a time; at least one."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    block, size, none = [], 0, True
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        text = row["text"].encode()
        if block and size + len(text) > block_bytes:
            yield Automaton(((i, words_of(t)) for i, t in block), window)
            block, size, none = [], 0, False
        block.append((row["item_id"], text))
        size += len(text)
    if block or none:
        yield Automaton(((i, words_of(t)) for i, t in block), window)


def _scanned(docs: DataFrame, held) -> DataFrame:
    """For each row of ``docs`` (id, text): id, n_words, spans of hit words, ids of items found. ``held``: a broadcast automaton."""

    def scan(batches):
        automaton = held.value
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in sliced(batches):
            n, spans, items = [], [], []
            for text in utf8(batch):
                words = words_of(text)
                s, i = automaton.hits(words) if len(words) >= automaton.shortest else ([], ())
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(sorted(i))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))], names=["id", "n_words", "spans", "items"])

    return docs.mapInArrow(scan, "id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")


def _by_block(rows: DataFrame, automata: Iterator[Automaton]) -> DataFrame:
    """``_scanned`` of rows with unique ids over several blocks, one after the other, and put together.

    Spans are sorted and may overlap. A block's automaton leaves the cluster before the next comes.
    """
    both = None
    for automaton in automata:
        held = rows.sparkSession.sparkContext.broadcast(automaton)
        part = written(_scanned(rows, held), "block")
        held.destroy()
        both = part if both is None else both.unionByName(part)
    return both.groupBy("id").agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def _covered(spans: Column) -> Column:
    """Words inside any of sorted spans."""
    zero = F.lit(0).cast("long")
    step = lambda s, x: F.struct((s["n"] + F.greatest(zero, x["end"] - F.greatest(s["upto"], x["start"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"))
    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("upto")), step)["n"]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items, contaminated`` for every row of ``docs``.

    A window is ``window`` words of an item in a row, or all words of a shorter one. Words of a
    document inside any occurrence are hit. contaminated: n_hit > 0 and coverage * n_hit >=
    n_words. Null text has no words; items without words, id or text match nothing; items that
    share an id count once. Repeated rows stay repeated, an empty table gives no rows, other
    columns are left out. Whole texts are read row by row, without a shuffle, once for each block
    of items; only for several blocks are results joined, by row number.
    """
    shipped(docs.sparkSession)
    automata = _automata(items, window, block_bytes)
    one, two = next(automata), next(automata, None)
    if two is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
        found = _scanned(rows, docs.sparkSession.sparkContext.broadcast(one)).withColumnRenamed("id", "doc_id")
    else:
        rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("id")), "documents")
        found = rows.select("doc_id", "id").join(_by_block(rows.select("id", "text"), chain((one, two), automata)), "id")
    found = found.withColumn("n_hit", _covered(F.col("spans")))
    return found.select("doc_id", "n_words", "n_hit", "spans", "items", ((F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def item_digest(items) -> str:
    """Hex digest of item ids, sorted as text and joined by commas."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, mode: str = "drop", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with contaminated documents dropped (mode "drop") or their hit words cut (mode "cut").

    A document under the coverage limit stays as it is. Cut spans take what stands between their
    words along. One pass over the texts for one block of items; several blocks are looked for
    one after the other, and a document is judged once, by the hits of all. Columns and rows as
    in ``docs``, whatever their names; nulls as in ``contamination``.
    """
    if mode not in ("drop", "cut"):
        raise ValueError("mode is drop or cut")
    shipped(docs.sparkSession)
    automata = _automata(items, window, block_bytes)
    one, two = next(automata), next(automata, None)
    at = docs.columns.index("text")
    if two is not None:
        rows = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("id")), "documents")
        hit = _covered(F.col("spans"))
        judged = _by_block(rows.select("id", F.col("doc")["text"].alias("text")), chain((one, two), automata)).where((hit > 0) & (coverage * hit >= F.col("n_words")))
        if mode == "drop":
            return rows.join(judged, "id", "left_anti").select("doc.*")
        return rows.join(judged.select("id", "spans"), "id", "left").select("doc", "spans").mapInArrow(lambda batches: _cut(batches, at), docs.schema)
    held = docs.sparkSession.sparkContext.broadcast(one)

    def clean(batches):
        automaton = held.value
        for batch in sliced(batches):
            stay, texts = [], batch.column(at).to_pylist()
            for k, text in enumerate(utf8(batch)):
                words = words_of(text)
                spans = automaton.hits(words)[0] if len(words) >= automaton.shortest else []
                hit = sum(b - a for a, b in spans)
                bad = hit > 0 and coverage * hit >= len(words)
                stay.append(not bad or mode == "cut")
                if bad and mode == "cut":
                    texts[k] = without(text, spans).decode()
            if mode == "cut":
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def without(text: bytes, spans: Sequence[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def _cut(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc, spans) as documents whose text, field ``at``, lacks the spans; null spans: as it is."""
    for batch in sliced(batches):
        fields = batch.column(0).flatten()
        texts = fields[at].to_pylist()
        for k, spans in enumerate(batch.column(1).to_pylist()):
            if spans:
                joined: list[tuple[int, int]] = []
                for s in sorted((x["start"], x["end"]) for x in spans):
                    if joined and joined[-1][1] >= s[0]:
                        joined[-1] = (joined[-1][0], max(joined[-1][1], s[1]))
                    else:
                        joined.append(s)
                texts[k] = without(texts[k].encode(), joined).decode()
        fields[at] = pa.array(texts, fields[at].type)
        yield pa.RecordBatch.from_arrays(fields, names=[f.name for f in batch.column(0).type])
