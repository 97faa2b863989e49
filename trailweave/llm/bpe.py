"""Byte-level BPE as a tree reduction: halves are encoded alone and joined at their border."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.cluster import shipped
from trailweave.llm.texts import sliced

#: Bytes of a piece that are merged directly: the leaves of the tree.
LEAF = 24
#: Pieces a worker remembers before it forgets all, and the longest of them in characters.
REMEMBERED, SHORT = 200_000, 64


class Bpe:
    """Encoder and decoder for one list of ranks (token bytes to id, lower merges first)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.remembered = ranks, remembered
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.split = regex.compile(pattern).findall
        self._stable: dict[tuple[int, int], bool] = {}
        outer = self

        class Known(dict):
            """Piece to its ids as little-endian 32-bit integers."""

            def __missing__(self, piece: str) -> bytes:
                out = np.array(outer.piece(piece.encode()), "<u4").tobytes()
                if len(piece) <= SHORT:
                    if len(self) >= outer.remembered:
                        self.clear()
                    self[piece] = out
                return out

        self.known = Known()

    def piece(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data)

    def leaf(self, data: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost first, until none is left."""
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 60:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 60)
        return [self.ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of two tokens gives those tokens.

        A list of tokens is the encoding of its bytes if this holds for all its neighbours: the
        first merge across a border of the list would also happen with the two tokens alone.
        """
        key = (a, b)
        found = self._stable.get(key)
        if found is None:
            if len(self._stable) >= self.remembered:
                self._stable.clear()
            found = self._stable[key] = self.leaf(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both parts' bytes, from their own encodings.

        The window around the border doubles on the side that isn't stable yet; what lies outside
        is kept as soon as the window's outer neighbours are stable.
        """
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            data = b"".join(self.bytes_of[t] for t in [*left[len(left) - i :], *right[:j]])
            window = self.leaf(data) if len(data) <= 2 * LEAF or (i == len(left) and j == len(right) and i + j < 4) else self._window(left[len(left) - i :], right[:j], data)
            ok_left = i == len(left) or self.stable(left[-i - 1], window[0])
            ok_right = j == len(right) or self.stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 if ok_left else 2), j * (1 if ok_right else 2)

    def _window(self, left: list[int], right: list[int], data: bytes) -> list[int]:
        """A long window is merged with a heap: each merge costs the logarithm of its length."""
        import heapq

        n, get = len(data), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            k = after[i] if alive[i] else n
            if not alive[i] or k >= n or end[k] != stop:
                continue
            alive[k], end[i], after[i] = 0, stop, after[k]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return [self.ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def tree(self, data: bytes) -> list[int]:
        """Encodes halves down to leaves of LEAF bytes and joins them pair by pair, level by level."""
        if len(data) <= LEAF:
            return self.leaf(data)
        level = [self.leaf(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: Iterable[int], leaf: int = 4096) -> bytes:
        """Bytes of the ids; leaves are concatenated up the tree."""
        ids, of = list(ids), self.bytes_of
        level = [b"".join([of[t] for t in ids[i : i + leaf]]) for i in range(0, len(ids), leaf)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoded(docs: DataFrame, tokenizer: str = "byte_bpe_multi_50k.tiktoken", remembered: int = REMEMBERED) -> DataFrame:
    """All columns of ``docs`` and ``token_ids`` (array<int>); null text stays null and has no ids.

    ``tokenizer`` names a vocabulary file of the installed package, or is a path. Row by row in
    Arrow batches; a worker loads the file itself. No special tokens. Whole texts of any length;
    repeated rows stay repeated; an empty table gives no rows; a column token_ids is replaced.
    """
    return _mapped(docs, tokenizer, remembered, digests=False)


def digests(docs: DataFrame, tokenizer: str = "byte_bpe_multi_50k.tiktoken", remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes, decodes the ids, digests both.

    One row for each row of ``docs``; null text is ''; other columns are left out.
    """
    return _mapped(docs, tokenizer, remembered, digests=True)


def _mapped(docs: DataFrame, tokenizer: str, remembered: int, digests: bool) -> DataFrame:
    shipped(docs.sparkSession)
    keep = ["doc_id"] if digests else [c for c in docs.columns if c not in ("text", "token_ids")]
    rows = docs.select(F.col("doc_id").cast("long"), "text") if digests else docs.select(*keep, "text")

    def run(batches):
        import public_tokenizers

        bpe = Bpe(load_ranks(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)), public_tokenizers.PATTERN, remembered)
        for batch in sliced(batches):
            out = [bpe.encode(x or "") for x in batch.column(len(keep)).to_pylist()]
            if digests:
                decoded = [hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in out]
                ids = [hashlib.sha256(x).hexdigest() for x in out]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*keep, "text", "token_ids"])

    if digests:
        return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return rows.mapInArrow(run, rows.withColumn("token_ids", F.array(F.lit(0)).cast("array<int>")).schema)
