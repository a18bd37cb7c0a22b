"""Quality rules by repetition coverage (operator 9).

Rolling hashes of several n-gram lengths mark the words that stand in a repeated n-gram; what counts is the share of a
text's characters below those marks, and inside repeated lines. Every text is measured on its own, so the work is a map
over the table: no shuffle, and any key may hold any share of the rows.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.

Defined results: a null or empty text has no words, fails the base rule and is dropped; repeated rows are judged alike,
row by row; a table without rows gives none. Null ids and further columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import chunks, tune

#: n-gram length -> largest share of word characters inside repeated n-grams of that length.
COVERAGE_LIMITS = {5: 0.36, 8: 0.30, 10: 0.28}
#: Largest share of word characters inside lines that repeat an earlier one.
LINE_LIMIT = 0.30
#: Largest share of symbol characters against word characters.
SYMBOL_LIMIT = 0.10
MIN_WORDS = 20
BASE_LENGTH, BASE_PERCENT = 8, 30
SYMBOLS = b"#*$%&|<>"

_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


class _Ids(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values of small integers."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(hashes: np.ndarray, at: np.ndarray, n: int, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of the windows that start `at`, those found twice or more in their text.

    Windows with equal hashes are compared word by word; were two different ones to meet, the windows are grouped by
    their words instead.
    """
    order = np.argsort(hashes, kind="stable")
    ordered = at[order]
    same = hashes[order][1:] == hashes[order][:-1]
    p, q = ordered[1:][same], ordered[:-1][same]
    equal = doc[p] == doc[q]
    for k in range(n):
        equal &= ids[p + k] == ids[q + k]
    if not equal.all():
        rows = np.stack([doc[at], *(ids[at + k] for k in range(n))], axis=1)
        _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        return at[count[inverse.ravel()] > 1]
    return np.concatenate([p, q])


def measure(texts: list[str | None], lengths: tuple[int, ...]) -> pd.DataFrame:
    """Counts of each text; `cover_n` are the characters and `words_n` the words inside repeated n-grams."""
    n_docs = len(texts)
    numbering, parts, sizes = _Ids(), [], np.zeros(n_docs, np.int64)
    symbols, dup_lines, dup_line_chars = (np.zeros(n_docs, np.int64) for _ in range(3))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        sizes[i] = len(words)
        parts.append(np.fromiter(map(numbering.__getitem__, words), np.int64, len(words)))
        symbols[i] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        if len(set(lines)) < len(lines):
            seen: set[bytes] = set()
            for line in lines:
                if line in seen:
                    dup_lines[i] += 1
                    dup_line_chars[i] += sum(len(w.decode("utf-8", "surrogatepass")) for w in line.split())
                seen.add(line)
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in numbering), np.int64, len(numbering))[ids]
    doc = np.repeat(np.arange(n_docs), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    out = {
        "n_words": sizes, "n_symbols": symbols, "n_dup_lines": dup_lines, "dup_line_chars": dup_line_chars,
        "word_chars": np.bincount(doc, chars, n_docs).astype(np.int64),
    }
    word = _mixed(np.arange(len(numbering)))[ids]
    rolled = word.copy()
    for n in range(1, max(lengths) + 1):
        if n > 1:  # the hash of n words from that of the first n - 1
            rolled = rolled[:-1] * _RADIX + word[n - 1 :] if len(rolled) else rolled
        if n not in lengths:
            continue
        at = np.flatnonzero(np.arange(len(rolled)) + n <= ends[: len(rolled)])
        marks = np.zeros(len(ids) + 1, np.int64)
        if len(at):
            starts = np.unique(_repeated(rolled[at] ^ _mixed(doc[at] + (1 << 40)), at, n, ids, doc))
            marks[starts] += 1
            np.add.at(marks, starts + n, -1)
        covered = np.cumsum(marks)[:-1] > 0
        out[f"words_{n}"] = np.bincount(doc[covered], minlength=n_docs).astype(np.int64)
        out[f"cover_{n}"] = np.bincount(doc[covered], chars[covered], n_docs).astype(np.int64)
    return pd.DataFrame(out)


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars")


def rule_measures(text: Column, lengths: tuple[int, ...] = (5, 8, 10)) -> Column:
    """Struct of the counts of a text."""
    names = [*_FIELDS, *(f"{kind}_{n}" for n in lengths for kind in ("words", "cover"))]

    def run(series: pd.Series) -> pd.DataFrame:
        values = [x if isinstance(x, str) else None for x in series]
        found = [measure(values[a:b], lengths) for a, b in chunks(values)]
        return pd.concat(found, ignore_index=True)[names] if found else pd.DataFrame({x: np.zeros(0, np.int64) for x in names})

    return F.pandas_udf(run, ", ".join(f"{x} long" for x in names), F.PandasUDFType.SCALAR)(text)


def judged(docs: DataFrame, text_col: str = "text", out: str = "rules") -> DataFrame:
    """`docs` with one struct column: the counts, the share of each coverage, `base_failed` and `kept`."""
    tune(docs.sparkSession)
    m = F.col(out)
    base = (m["n_words"] < MIN_WORDS) | (100 * m[f"words_{BASE_LENGTH}"] > BASE_PERCENT * m["n_words"])
    share = lambda name: m[name] / F.greatest(m["word_chars"], F.lit(1))
    over = [share(f"cover_{n}") > limit for n, limit in COVERAGE_LIMITS.items()]
    over += [share("dup_line_chars") > LINE_LIMIT, share("n_symbols") > SYMBOL_LIMIT]
    failed = base
    for rule in over:
        failed = failed | rule
    found = docs.withColumn(out, rule_measures(F.col(text_col), tuple(COVERAGE_LIMITS)))
    return found.withColumn(out, m.withField("base_failed", base).withField("kept", ~failed))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass, with the columns they came with."""
    name = next(f"rules{i}" for i in range(len(docs.columns) + 1) if f"rules{i}" not in docs.columns)
    return judged(docs, text_col, name).where(F.col(f"{name}.kept")).drop(name)
