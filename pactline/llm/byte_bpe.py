"""Byte-level BPE by monoid tree reduction (operator 8).

A piece of text is encoded from its halves: `join` takes the encodings of two neighbours to the encoding of both. It
re-encodes a window over the boundary and lets it grow until the tokens outside are proven to stand. The proof: a
sequence of tokens is the encoding of its bytes exactly if every pair of neighbours is the encoding of their own bytes.
Inside either half and inside the window that holds already, so the two seams are all there is to check.

Decoding joins the bytes of blocks of tokens pairwise up the tree.

A text is mapped on its own, whole; no shuffle. Memory holds the rank table and caches of bounded size.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded alike; a table
without rows gives none; other columns are not touched. Ids outside the vocabulary raise an error in decoding.
"""

from __future__ import annotations

import base64
import heapq
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

CACHE_ENTRIES = 250_000
WORD_ENTRIES = 600_000
LEAF_BYTES = 4
PART_BYTES = 8
PLAIN_BYTES = 64
DECODE_BLOCK = 2048


class TreeBPE:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pieces = regex.compile(pattern)
        #: A space that does not stand alone between two other characters.
        self.loose = regex.compile(r"\s | \s|^ | $")
        self._windows: dict[bytes, tuple[int, ...]] = {}
        self._stands: dict[tuple[int, int], bool] = {}
        self._words: dict[str, bytes] = {}

    # Windows: the merges of lowest rank first, leftmost among equals.

    def _merged(self, data: bytes) -> tuple[int, ...]:
        found = self._windows.get(data)
        if found is None:
            found = self._merged_plain(data) if len(data) <= PLAIN_BYTES else self._merged_heap(data)
            if len(data) <= PLAIN_BYTES:
                if len(self._windows) >= CACHE_ENTRIES:
                    self._windows.clear()
                self._windows[data] = found
        return found

    def _merged_plain(self, data: bytes) -> tuple[int, ...]:
        rank_of, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        ranks = [rank_of(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return tuple(map(self.ranks.__getitem__, parts))
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank_of(parts[k] + parts[k + 1])
            if k:
                ranks[k - 1] = rank_of(parts[k - 1] + parts[k])

    def _merged_heap(self, data: bytes) -> tuple[int, ...]:
        n, rank_of = len(data), self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] < n:
                before[after[i]] = i
                if (r := rank_of(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := rank_of(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return tuple(self.ranks[data[i : end[i]]] for i in range(n) if alive[i])

    def _stand(self, a: int, b: int) -> bool:
        """Whether two neighbours are the encoding of their own bytes."""
        known = self._stands.get((a, b))
        if known is None:
            known = self._merged(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
            if len(self._stands) >= CACHE_ENTRIES:
                self._stands.clear()
            self._stands[a, b] = known
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encodings' bytes together."""
        if not left or not right or self._stand(left[-1], right[0]):
            return left + right
        i, j, n, m = 1, 1, len(left), len(right)
        while True:
            window = self._merged(b"".join(self.bytes_of[t] for t in (*left[n - i :], *right[:j])))
            left_holds = i == n or self._stand(left[n - i - 1], window[0])
            right_holds = j == m or self._stand(window[-1], right[j])
            if left_holds and right_holds:
                return left[: n - i] + window + right[j:]
            if not left_holds:
                i = min(n, 2 * i)
            if not right_holds:
                j = min(m, 2 * j)

    def tree(self, data: bytes) -> tuple[int, ...]:
        """The encoding of a piece from those of its halves."""
        known = self._windows.get(data)
        if known is not None:
            return known
        if len(data) <= LEAF_BYTES:
            return self._merged(data) if data else ()
        middle = len(data) // 2
        found = self.join(self.tree(data[:middle]), self.tree(data[middle:]))
        if len(data) <= PART_BYTES:
            self._windows[data] = found
        return found

    def _word(self, text: str) -> bytes:
        """Ids, packed, of a run of text that no piece crosses."""
        ids: list[int] = []
        for piece in self.pieces.findall(text):
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)  # a piece that is a token needs no merges
            ids.extend(self.tree(data) if whole is None else (whole,))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= PLAIN_BYTES:
            if len(self._words) >= WORD_ENTRIES:
                self._words.clear()
            self._words[text] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.loose.search(text):
            runs = self.pieces.findall(text)
        else:  # every space stands alone and belongs to the piece after it
            first, *rest = text.split(" ")
            runs = [first, *(" " + x for x in rest)]
        known, word = self._words.get, self._word
        return b"".join([known(run) or word(run) for run in runs])

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        bytes_of, ids = self.bytes_of, np.frombuffer(packed, "<u4").tolist()
        level = [b"".join([bytes_of[t] for t in ids[i : i + DECODE_BLOCK]]) for i in range(0, len(ids), DECODE_BLOCK)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> TreeBPE:
    """The rank file of a public tokenizer, as every worker has it installed."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return TreeBPE(ranks, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Packed ids of a text."""

    def run(series: pd.Series) -> pd.Series:
        bpe = load(path, pattern)
        return pd.Series([bpe.encode(x if isinstance(x, str) else None) for x in series], dtype=object)

    return F.pandas_udf(run, "binary", F.PandasUDFType.SCALAR)(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of packed ids; none for null."""

    def run(series: pd.Series) -> pd.Series:
        bpe = load(path, pattern)
        return pd.Series([bpe.decode(bytes(x)) if x is not None else b"" for x in series], dtype=object)

    return F.pandas_udf(run, "binary", F.PandasUDFType.SCALAR)(ids)
