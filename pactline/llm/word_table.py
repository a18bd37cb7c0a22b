"""BPE encoding and decoding through a table of distinct words (operator 13).

Encoding. Words are runs of text between single spaces, each with the space before it. Merges never cross them, so a word's ids
are the same wherever it stands.
1. Tasks split texts into words, in slices of some thousand documents. A slice has a list of its distinct words, and each of
   its documents the places of its words there, in order.
2. The lists are cut into buckets by a hash of the word, and the buckets of all slices meet: the table of distinct words, a
   part of it in each task, where a word is encoded once. A frequent word comes once a slice, not once an occurrence, so none
   is hot. Lists are compressed: as one row a word they took three times the input in shuffles.
3. The ids go back to their slices and join its documents by position.

Decoding joins ids with the table of pieces, which the vocabulary bounds (50,257 rows), by id: that table is on every worker,
and the pieces of a batch of documents are gathered at once, in order.

Texts are split twice, for the words and for the numbers, since that is cheaper than to store either; the slices must come out
alike, so `docs` must give the same rows in the same order when read again, as a table of files does. A slice's checksum is
compared, and an error raised, where it doesn't.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows and rows of null id are encoded
each for itself; a text of any length is one row of its slice; the special string inside a text is its own id, as in the
library; an empty table gives no rows. Other columns are not read. Ids outside the vocabulary raise an error in decoding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import tune

#: A slice ends behind the document that brings it to so many distinct words, characters or documents.
SLICE = 56_000, 8_000_000, 8_000
#: A task forgets a bucket's table beyond so many words, and encodes again what it meets later.
TABLE_WORDS = 2_000_000
SEPARATOR = b"\xff"
#: Fixed by the published vocabulary: the pieces of the byte-level tokenizer.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point the library and the regular expression agree on what is a letter; above, the library is asked.
AGREED = "\u0558"


class Words:
    """A byte-level BPE file: the words of a text, their ids, and the bytes of each id. Read in parts, as a task needs them."""

    def __init__(self, path: str):
        self.path = path
        self.special = {t["content"]: t["id"] for t in self._part("added_tokens")}
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.pattern = regex.compile(PIECE)
        self.loose = re.compile(r"\s | \s|^ | $")

    def _part(self, member: str):
        """One member of the file, without the others in memory."""
        with open(self.path, encoding="utf-8") as file:
            text = file.read()
        start = re.search(rf'"{member}"\s*:\s*', text).end()
        return json.JSONDecoder().raw_decode(text, start)[0]

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def letters(self) -> list[str]:
        """The letter that stands for each byte in the vocabulary."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        return [other.get(b, chr(b)) for b in range(256)]

    @cached_property
    def pieces(self) -> pa.Array:
        """The bytes of each id: the table that decoding joins."""
        byte_of = {c: b for b, c in enumerate(self.letters)}
        found = {i: bytes(map(byte_of.__getitem__, piece)) for piece, i in self._part("vocab").items()}
        found |= {i: s.encode() for s, i in self.special.items()}
        return pa.array([found.get(i) for i in range(max(found) + 1)], pa.large_binary())

    def pieces_of(self, text: str) -> list[str]:
        """What the tokenizer splits a text without special strings into."""
        if text.isascii() or max(text, default="") < AGREED:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _words(self, text: str) -> list[str]:
        """Runs that no merge crosses. A space that stands alone between two other characters begins what follows it; where
        all spaces do, the text falls apart at them, and else into the tokenizer's pieces."""
        if self.loose.search(text):
            return self.pieces_of(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def split(self, text: str | None) -> list[str]:
        """The words of a text, special strings among them."""
        if not text:
            return []
        if not self.special or "<" not in text and all("<" in s for s in self.special):
            return self._words(text)
        parts = enumerate(self.marks.split(text))
        return [w for k, part in parts if part for w in ([part] if k % 2 else self._words(part))]

    def ids(self, word: str) -> np.ndarray:
        """Of one word, by the merges of the file."""
        if word in self.special:
            return np.array([self.special[word]], "<u4")
        found: list[int] = []
        for piece in self.pieces_of(word):
            found += [t.id for t in self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, piece.encode())))]
        return np.array(found, "<u4")


@lru_cache(maxsize=2)
def load(path: str) -> Words:
    """The file of a public tokenizer, as every worker has it installed."""
    return Words(path)


@dataclass
class Slice:
    """A run of documents: their ids, the words of each as places in `words`, and its distinct words by bucket."""

    number: int
    keys: list[pa.Array]
    docs: list[list[int]]
    words: list[bytes]
    counts: np.ndarray  # words of each bucket
    place: np.ndarray  # of the words as the documents number them

    @property
    def checksum(self) -> int:
        return zlib.crc32(SEPARATOR.join(self.words))


def _slices(batches: Iterator[pa.RecordBatch], path: str, buckets: int, most: tuple[int, int, int]) -> Iterator[Slice]:
    """The slices of a task. Their words are sorted by bucket, which is a hash of the word, and then as they first come."""
    words, number = load(path), TaskContext.get().partitionId() << 32
    keys: list[pa.Array] = []
    docs: list[list[int]] = []
    known: dict[str, int] = {}
    chars = 0

    def closed() -> Slice:
        spelled = [w.encode() for w in known]
        bucket = np.fromiter((zlib.crc32(w) for w in spelled), np.int64, len(spelled)) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return Slice(number, keys, docs, [spelled[i] for i in order.tolist()], np.bincount(bucket, minlength=buckets), place)

    for batch in batches:
        key, start = batch.column("id"), 0
        for i, text in enumerate(batch.column("text").to_pylist()):
            docs.append([known.setdefault(w, len(known)) for w in words.split(text)])
            chars += len(text or "")
            if len(known) >= most[0] or chars >= most[1] or len(docs) >= most[2]:
                keys.append(key.slice(start, i + 1 - start))
                yield closed()
                keys, docs, known, chars, start, number = [], [], {}, 0, i + 1, number + 1
        keys.append(key.slice(start))
    if docs:
        yield closed()


def _packed(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def _unpacked(data: bytes) -> bytes:
    return zstandard.decompress(data)


def _packed_numbers(numbers: np.ndarray) -> bytes:
    """In as few bytes each as the largest takes: one, two or four, which a first byte says."""
    width = next(w for w in (1, 2, 4) if int(numbers.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + _packed(numbers.astype(f"<u{width}").tobytes())


def _unpacked_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(_unpacked(data[1:]), f"<u{data[0]}")


def _distinct(path: str, buckets: int, most: tuple[int, int, int]) -> Callable:
    """A row for each slice and bucket: the words, which a byte separates that no UTF-8 text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches, path, buckets, most):
            full = np.flatnonzero(s.counts)
            ends = np.cumsum(s.counts)
            blobs = [_packed(SEPARATOR.join(s.words[ends[b] - s.counts[b] : ends[b]])) for b in full.tolist()]
            n = len(full)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.number] * n, pa.int64()), pa.array(full, pa.int32()), pa.array(blobs, pa.binary()), pa.array([s.checksum] * n, pa.int64())],
                names=["slice", "bucket", "words", "checksum"],
            )

    return run


def _numbered(path: str, buckets: int, most: tuple[int, int, int]) -> Callable:
    """A row for each slice: the ids of its documents, how many words each has, and the words' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches, path, buckets, most):
            counts = np.array([len(d) for d in s.docs], np.int32)
            at = s.place[np.fromiter(chain.from_iterable(s.docs), np.int64, int(counts.sum()))]
            keys = pa.concat_arrays(s.keys)
            columns = [
                pa.array([s.number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([_packed_numbers(at)], pa.binary()),
                pa.array([s.checksum], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "ids", "counts", "at", "checksum"])

    return run


def _encoded(path: str) -> Callable:
    """The ids of each row's words. Rows come by bucket, and a bucket's distinct words are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = load(path), None
        table: dict[bytes, bytes] = {}
        for batch in batches:
            sizes, found = [], []
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if bucket != last or len(table) > TABLE_WORDS:
                    last, table = bucket, {}
                ids = []
                for word in _unpacked(blob).split(SEPARATOR):
                    known = table.get(word)
                    if known is None:
                        known = table[word] = words.ids(word.decode()).tobytes()
                    ids.append(known)
                sizes.append(_packed_numbers(np.array([len(x) // 4 for x in ids], "<u4")))
                found.append(_packed_numbers(np.frombuffer(b"".join(ids), "<u4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("slice"), batch.column("bucket"), pa.array(sizes, pa.binary()), pa.array(found, pa.binary()), batch.column("checksum")],
                names=["slice", "bucket", "sizes", "ids", "checksum"],
            )

    return run


def _by_position(docs: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a slice's documents, from the places of their words and the ids of each word."""
    words = words.sort_by("bucket")
    if set(words["checksum"].to_pylist()) - set(docs["checksum"].to_pylist()):
        raise RuntimeError("the documents were not read alike twice: encode a table of files")
    size, held = (
        np.concatenate([np.zeros(0, kind), *(_unpacked_numbers(x).astype(kind) for x in words[c].to_pylist())])
        for c, kind in (("sizes", np.int64), ("ids", "<u4"))
    )
    at = _unpacked_numbers(docs["at"][0].as_py())
    first, ends = np.cumsum(size) - size, np.append(0, np.cumsum(docs["counts"].combine_chunks().values.to_numpy()))
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        part = at[a:b]
        n = size[part]
        till = np.cumsum(n)
        place = np.repeat(first[part] - till + n, n) + np.arange(int(till[-1]) if len(till) else 0)
        out.append(held[place].tobytes())
    return pa.table({"id": docs["ids"].combine_chunks().values, "ids": pa.array(out, pa.binary())})


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: tuple[int, int, int] = SLICE
) -> DataFrame:
    """`id, ids`: the ids of every text, packed as little-endian unsigned 32-bit integers. `most` bounds a slice."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = rows.mapInArrow(_distinct(path, buckets, most), "slice long, bucket int, words binary, checksum long")
    table = words.repartition("bucket").sortWithinPartitions("bucket")
    table = table.mapInArrow(_encoded(path), "slice long, bucket int, sizes binary, ids binary, checksum long")
    numbers = rows.mapInArrow(_numbered(path, buckets, most), f"slice long, ids array<{kind}>, counts array<int>, at binary, checksum long")
    joined = numbers.groupBy("slice").cogroup(table.groupBy("slice"))
    return joined.applyInArrow(_by_position, f"id {kind}, ids binary")


def decode(ids: Column, path: str) -> Column:
    """The text of packed ids, special ids as their strings; bytes that are no UTF-8 become U+FFFD. Null gives an empty text."""

    def run(series: pd.Series) -> pd.Series:
        pieces = load(path).pieces
        out = []
        for raw in series:
            at = np.frombuffer(raw if raw is not None else b"", "<u4")
            if len(at) and int(at.max()) >= len(pieces):
                raise ValueError("an id outside the vocabulary")
            found = pieces.take(pa.array(at, pa.uint32()))
            if found.null_count:
                raise ValueError("an id outside the vocabulary")
            _, offsets, data = found.buffers()
            last = int(np.frombuffer(offsets, np.int64)[len(at)]) if len(at) else 0
            out.append(data[:last].to_pybytes().decode("utf-8", "replace") if last else "")
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(ids)
