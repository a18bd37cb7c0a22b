"""Packing token sequences by Karmarkar-Karp multiway differencing (operator 5).

1. Texts become token ids (one map) and are written once. A worker encodes each distinct run between ASCII white space
   once, as this tokenizer's normalizer and splitter never look across white space.
2. Whole windows are cut from long documents; what is left of each document is one item. A smaller `item_tokens` cuts it
   again, which balances little better and breaks documents up.
3. Items are dealt to groups by their running sum over the written files: a group has some `group_windows` windows' worth,
   whatever the keys are.
4. In a group the items are numbers to be split over `m` windows. Every item starts as a partial partition (its size, and
   m - 1 empty windows). The two partial partitions of widest spread are merged, the fullest windows of one with the
   emptiest of the other, until one is left. If its fullest window is over the capacity, m rises and the group is split anew.
5. The plan, a few numbers a piece, joins the written ids, and each piece is cut out.

Defined results: a null or empty text is the end token alone; repeated rows are packed each for itself; rows of null id are
packed too; a table without rows gives none; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.llm.common import stored, tune

CAPACITY = 4096
ITEM_TOKENS = CAPACITY
GROUP_WINDOWS = 128
#: An item counts at least this much towards the size of its group, which bounds the items of a group.
LEAST_WEIGHT = 64
WORD_ENTRIES = 600_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Packed ids of texts, by the runs between ASCII white space.

    A run of small Latin letters, with ASCII punctuation behind it or not, falls into words that the normalizer leaves as
    they are, so it goes to the tokenizer's BPE model at once; any other run goes through the whole tokenizer.
    """

    _TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Special strings are taken out first, in the spelling of the file; what a lower-cased text looks like is ordinary text.
        self.special = {t.content: self._packed([i]) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[bytes, bytes] = {}

    def _run(self, raw: bytes) -> bytes:
        found = self.known.get(raw)
        if found is None:
            text = raw.decode()
            word = text.rstrip(self._TAIL)
            if word and word.isalpha() and word.islower() and word.lower() == word and max(word) < "\u0250":
                letters = raw if word.isascii() and len(word) == len(text) else word.encode()
                found = self._packed([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, letters)))])
                if len(word) < len(text):
                    found += self._run(text[len(word) :].encode())
            else:
                found = self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
            if len(self.known) >= WORD_ENTRIES:
                self.known.clear()
            self.known[raw] = found
        return found

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None, end_id: int) -> bytes:
        end = struct.pack("<I", end_id)
        if not text:
            return end
        if "<|" not in text or not self.marks.search(text):
            return self._runs(text) + end
        return b"".join([*[self.special.get(part) or self._runs(part) for part in self.marks.split(text)], end])

    def _runs(self, text: str) -> bytes:
        # the vocabulary is of lower case, so ASCII capitals may fall at once
        known, run = self.known.get, self._run
        return b"".join([known(x) or run(x) for x in text.encode("utf-8", "surrogatepass").lower().split()])


@lru_cache(maxsize=2)
def load(path: str) -> WordTokens:
    return WordTokens(path)


def token_ids(text: Column, path: str, end_id: int) -> Column:
    """Ids of a text and the end token, as little-endian unsigned 32-bit integers."""

    def run(series: pd.Series) -> pd.Series:
        tokens = load(path)
        return pd.Series([tokens.encode(x if isinstance(x, str) else None, end_id) for x in series], dtype=object)

    return F.pandas_udf(run, "binary", F.PandasUDFType.SCALAR)(text)


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """The window, from 0 to m - 1, of each item: largest differencing of m-part partitions."""
    n = len(sizes)
    # a node is an item (below n) or two nodes that share a window
    left, right = [], []
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for k, i in enumerate(np.argsort(-sizes, kind="stable").tolist()):
        sums, nodes = np.zeros(m, np.int64), np.full(m, -1, np.int64)
        sums[0], nodes[0] = sizes[i], i
        heap.append((-int(sizes[i]) if m > 1 else 0, k, sums, nodes))
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)  # sums descend
        _, _, other, theirs = heapq.heappop(heap)
        sums, theirs = sums + other[::-1], theirs[::-1]
        shared = np.flatnonzero((nodes >= 0) & (theirs >= 0))
        both = np.where(nodes >= 0, nodes, theirs)
        left.extend(nodes[shared].tolist())
        right.extend(theirs[shared].tolist())
        both[shared] = n + len(left) - len(shared) + np.arange(len(shared))
        order = np.argsort(-sums, kind="stable")
        sums, both = sums[order], both[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), count, sums, both))
        count += 1
    window = np.zeros(n + len(left), np.int64)
    if heap:
        nodes = heap[0][3]
        window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for k in range(len(left) - 1, -1, -1):
        window[left[k]] = window[right[k]] = window[n + k]
    return window[:n]


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """As few near-equal windows as differencing finds within the capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, m)
        if not len(sizes) or np.bincount(found, sizes, m).max() <= capacity:
            return found
        m += max(1, m // 200)


def plan(tokens: DataFrame, capacity: int, item_tokens: int, group_windows: int) -> DataFrame:
    """`_file, _at, start, length, sequence_id, offset` of every piece, from the lengths alone."""
    rows = tokens.select("_file", "_at", "doc_tokens")
    full, rest = F.floor(F.col("doc_tokens") / capacity), F.col("doc_tokens") % capacity
    items = F.ceil(rest / item_tokens)
    weight = F.when(rest > 0, F.greatest(rest, items * LEAST_WEIGHT)).otherwise(0)
    rows = rows.withColumns({"full": full, "rest": rest, "items": items, "weight": weight})
    own = W.partitionBy("_file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    files = rows.groupBy("_file").agg(F.sum("full").alias("_full"), F.sum("weight").alias("_weight"))
    earlier = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    files = files.select("_file", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_full", "_weight")))
    rows = rows.join(files, "_file").withColumns(
        {c: F.col(f"_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in ("full", "weight")} | {"n_full": full}
    )
    whole = rows.where("n_full > 0").select(
        "_file", "_at", F.col("full"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_full") - 1)).alias("k")
    )
    whole = whole.select(
        "_file", "_at", (F.col("k") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"),
        (2 * (F.col("full") + F.col("k"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    group = F.floor(F.col("weight") / F.lit(capacity * group_windows))
    part = rows.where("rest > 0").select(
        "_file", "_at", (F.col("n_full") * capacity).alias("base"), "rest", group.alias("grp"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("items") - 1)).alias("k"),
    )
    part = part.select(
        "_file", "_at", "grp", (F.col("base") + F.col("k") * item_tokens).alias("start"),
        F.least(F.lit(item_tokens), F.col("rest") - F.col("k") * item_tokens).cast("long").alias("length"),
    )

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_file", "_at", "start"], ignore_index=True)
        window = windows(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = 2 * (frame["grp"] * (4 * group_windows + 64) + window) + 1
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame[["_file", "_at", "start", "length", "sequence_id", "offset"]]

    kinds = "_file string, _at long, start long, length long, sequence_id long, offset long"
    return whole.unionByName(part.groupBy("grp").applyInPandas(pack, kinds))


def packed(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    capacity: int = CAPACITY, item_tokens: int = ITEM_TOKENS, group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """Every piece with its ids: `id, start, length, ids, doc_tokens, sequence_id, offset`."""
    tune(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("id"), token_ids(F.col(text_col), path, end_id).alias("ids"))
    ids = stored(ids.withColumn("doc_tokens", (F.octet_length("ids") / 4).cast("long")), "tokens")
    ids = ids.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    pieces = stored(plan(ids, capacity, item_tokens, group_windows), "plan")
    cut = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    # merged at every size: where the plan is small, a broadcast would only make small runs differ from large ones
    return ids.join(pieces.hint("merge"), ["_file", "_at"]).select("id", "start", "length", cut.alias("ids"), "doc_tokens", "sequence_id", "offset")
