"""Quality classifier: a generalised additive model with pairwise interactions (operator 6).

Each text becomes a few numbers (shares of kinds of characters, lengths, repetition, how words spread). Every number is cut
into bins at quantiles of the training rows, and has a table of one addend a bin. The tables are learned by boosting shallow
trees in turns: feature after feature, round after round, a tree of a few leaves fits the gradients' sums by bin, and a
small part of it is added to that feature's table. Then the pairs whose joint table explains most of what is left are
boosted the same way, with one cut along each axis. The score is the logistic of the sum of a text's addends, all texts of
a batch at once.

Every row is scored from its whole text, in one map. Only the fit takes a bounded sample: the `MAX_TRAIN` labelled ids of the
smallest hash. The model is a few kB.

Defined results: a null or empty text has all features zero and gets their score; labels of null id or value teach nothing,
and of several labels of an id the smallest counts; with labels of one kind only every score is that label's share; repeated
rows are scored alike; a table without rows gives none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import tune

MAX_TRAIN = 40_000
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE, LEAVES, LEAST_ROWS = 0.1, 4, 5
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "short_words", "long_words", "upper", "digits", "spaces",
    "non_ascii", "symbols", "marks", "stops", "pipes", "exclamations", "brackets", "capital_words", "plain_words", "distinct_words",
    "top_word", "log_lines", "line_length", "short_lines", "repeated_lines", "line_stops", "repeated_pairs", "byte_entropy", "marked_words",
)

_KINDS = {
    "upper": bytes(range(65, 91)), "digits": b"0123456789", "spaces": b" \t\n\r\x0b\x0c", "non_ascii": bytes(range(192, 256)), "symbols": b"#*$%&|<>@^~_=+\\/",
    "marks": b",;:-'\"()", "stops": b".?!", "pipes": b"|", "exclamations": b"!", "brackets": b"{}[]<>",
}
_CONTINUED = bytes(range(128, 192))


def features(text: str | None) -> list[float]:
    """The numbers of a text, in the order of `FEATURES`."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(counts.sum() - counts[128:192].sum())
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = len(words)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = counts[counts > 0] / counts.sum()
    kinds = {name: float(counts[list(of)].sum()) / chars for name, of in _KINDS.items()}
    found = kinds | {
        "log_chars": np.log1p(chars), "log_words": np.log1p(n), "word_length": sizes.mean(), "word_length_spread": sizes.std(),
        "short_words": (sizes <= 2).mean(), "long_words": (sizes >= 12).mean(), "capital_words": sum(w[:1].isupper() for w in words) / n,
        "plain_words": sum(w.isalpha() for w in words) / n, "distinct_words": len(tally) / n, "top_word": max(tally.values()) / n,
        "log_lines": np.log1p(len(lines)), "line_length": np.log1p(chars / len(lines)), "short_lines": sum(len(x) < 30 for x in lines) / len(lines),
        "repeated_lines": 1 - len(set(lines)) / len(lines), "line_stops": sum(x.rstrip()[-1:] in b".?!" for x in lines) / len(lines),
        "repeated_pairs": 1 - len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1),
        "byte_entropy": float(-(shares * np.log2(shares)).sum()), "marked_words": sum(w[-2:-1] in b"#*$%&|<>!" and len(w) > 1 for w in words) / n,
    }
    return [float(found[name]) for name in FEATURES]


def feature_column(text: Column) -> Column:
    """The features as an array of floats."""

    def run(series: pd.Series) -> pd.Series:
        return pd.Series([features(x if isinstance(x, str) else None) for x in series], dtype=object)

    return F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR)(text)


@dataclass
class Model:
    """Lookup tables: one for each feature, one for each pair."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.start)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[:, a], bins[:, b]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(self.bins(x))))


def _tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, leaves: int) -> np.ndarray:
    """Addend of each bin from a tree of at most `leaves` leaves over the bins' sums."""
    cg, ch, cn = (np.concatenate([[0], np.cumsum(v)]) for v in (grad, hess, count))

    def cut(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        g, h, n = cg[at] - cg[a], ch[at] - ch[a], cn[at] - cn[a]
        whole_g, whole_h, whole_n = cg[b] - cg[a], ch[b] - ch[a], cn[b] - cn[a]
        gain = g**2 / (h + 1) + (whole_g - g) ** 2 / (whole_h - h + 1) - whole_g**2 / (whole_h + 1)
        gain = np.where((n >= LEAST_ROWS) & (whole_n - n >= LEAST_ROWS), gain, -np.inf)
        return (float(gain.max()), int(at[gain.argmax()])) if len(at) else (-np.inf, a)

    parts = [(0, len(grad))]
    while len(parts) < leaves:
        gain, at, k = max((*cut(*p), k) for k, p in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, at), (at, b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best table of one cut along each axis, and how much it explains."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (grad, hess))
    i, j = np.arange(1, cg.shape[0] - 1)[:, None], np.arange(1, cg.shape[1] - 1)[None, :]
    if not i.size or not j.size:
        return 0.0, np.zeros_like(grad)

    def four(c: np.ndarray) -> list[np.ndarray]:
        low, top, side = c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j]
        return [low, top, side, c[-1, -1] - low - top - side]

    g, h = four(cg), four(ch)
    gain = sum(x**2 / (y + 1) for x, y in zip(g, h, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    at = np.unravel_index(gain.argmax(), gain.shape)
    a, b = at[0] + 1, at[1] + 1
    out = np.empty_like(grad)
    values = [x[at] / (y[at] + 1) for x, y in zip(g, h, strict=True)]
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = values
    return float(gain[at]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Tables learned from features and labels 0 and 1."""
    if not len(y):
        return Model(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    share = (y.sum() + 0.5) / (len(y) + 1)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    if y.min() == y.max():
        return model
    bins, total = model.bins(x), np.full(len(y), model.start)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    sizes = [np.bincount(bins[:, j], minlength=len(t)) for j, t in enumerate(model.tables)]
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = gradients()
            step = RATE * _tree(np.bincount(bins[:, j], g, len(table)), np.bincount(bins[:, j], h, len(table)), sizes[j], LEAVES)
            table += step
            total += step[bins[:, j]]

    def joint(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = len(model.tables[a]), len(model.tables[b])
        return np.bincount(bins[:, a] * shape[1] + bins[:, b], v, shape[0] * shape[1]).reshape(shape)

    g, h = gradients()
    ranked = sorted(((_quadrants(joint(a, b, g), joint(a, b, h))[0], a, b) for a in range(len(edges)) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 1e-9]
    model.pair_tables = [np.zeros((len(model.tables[a]), len(model.tables[b]))) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = gradients()
            step = RATE * _quadrants(joint(a, b, g), joint(a, b, h))[1]
            table += step
            total += step[bins[:, a], bins[:, b]]
    return model


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """A model from the labels (`id, label`, 0 or 1) of the ids where `learn`, a condition on `id`, holds.

    The ids are chosen first, at most `max_train`, so only their texts are looked at.
    """
    tune(docs.sparkSession)
    known = labels.where("id IS NOT NULL AND label IN (0, 1)").where(learn).groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")  # max_train rows
    rows = rows.select("label", F.xxhash64("id", "t").alias("o"), feature_column(F.col("t")).alias("f"))
    sample = rows.orderBy("o").limit(max_train).toPandas()
    x = np.array(sample["f"].tolist(), np.float32).reshape(len(sample), len(FEATURES))
    y = sample["label"].to_numpy(float)
    order = np.lexsort((*x.T, y, sample["o"].to_numpy()))  # the same model whatever order the rows came in
    return fit(x[order], y[order])


def score(text: Column, model: Model) -> Column:
    """Score of a whole text."""

    def run(series: pd.Series) -> pd.Series:
        x = np.array([features(t if isinstance(t, str) else None) for t in series], np.float32)
        return pd.Series(model.scores(x.reshape(len(series), len(FEATURES))))

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)(text)


def keep_good(
    docs: DataFrame, labels: DataFrame, learn: Column, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows that score at least `least`, with the columns they came with."""
    return docs.where(score(F.col(text_col), train(docs, labels, learn, MAX_TRAIN, id_col, text_col)) >= least)
