"""Language identification by interpolated Kneser-Ney character models (operator 1).

Learning. Letters are lower-cased, everything else is one space, and each text counts as its 4-grams of characters, packed
into 64 bits. Tasks add up their own counts before the shuffle; the lower orders come from the distinct grams of the order
above (in how many contexts a gram continues), as Kneser-Ney wants it. All counts cover all training rows.

Model. For each language and order a sorted array of grams with their discounted probabilities, and one of contexts with the
weight of the lower order. Grams are whole 64-bit keys, so none is taken for another. The model grows with the distinct grams
of a language, at 12 bytes an entry; it is collected and broadcast, so it must fit the driver and each Python worker.

Scoring. Each batch looks up its distinct 4-grams once. The language of the lowest cross-entropy a character wins. The
score is the probability that the winner is right, calibrated on the training rows by the margin to the second; texts
whose cross-entropy is beyond what their language shows in training, or of a score under a half, are marked `rejected`.

Defined results: a null text, or one without a letter, is `und` with score 0; without training rows everything is `und`;
rows of null language or id train nothing if the caller says so; repeated rows count again; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import chunks, stored, tune

ORDER = 4
UNIFORM = 1.0 / 4096
#: Margins are binned on a logarithmic scale into this many bins for calibration.
BINS = 64
#: Standard deviations above the training mean at which a cross-entropy is rejected.
REJECT_SD = 4.0
UNDECIDED = "und"


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Code point -> 16-bit code: a lower-case letter, or 32 for anything else. Letters beyond 16 bits are folded into them."""
    codes = np.full(0x110000, 32, np.uint64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            codes[cp] = max(ord(low) if len(low) == 1 else cp, 33) if cp < 0x10000 else 0xE000 + cp % 0x1800
    return codes


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 4-grams of the texts and the text each belongs to."""
    raw = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    # three spaces in front of each text, one behind
    lead = ORDER - 1
    total = int(sizes.sum()) + len(texts) * (lead + 1)
    codes, doc = np.full(total, 32, np.uint64), np.repeat(np.arange(len(texts)), sizes + lead + 1)
    starts = np.cumsum(sizes + lead + 1) - (sizes + lead + 1)
    letters = _alphabet()
    for at, x in zip(starts.tolist(), raw, strict=True):
        codes[at + lead : at + lead + len(x)] = letters[x]
    place = np.arange(total) - starts[doc]
    # runs of other characters are one space
    keep = (codes != 32) | (place < lead) | np.concatenate([[True], codes[:-1] != 32])
    codes, doc, place = codes[keep], doc[keep], place[keep]
    packed = codes.copy()
    for k in range(1, ORDER):
        packed[k:] |= codes[:-k] << np.uint64(16 * k)
    inner = place >= lead
    return packed[inner], doc[inner]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _suffix(gram: str, order: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << (16 * order)) - 1)) if order < 4 else F.col(gram)


def gram_counts(rows: DataFrame) -> DataFrame:
    """`lang, gram, n` over all rows of `lang, text`."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                texts = part["text"].tolist()
                for a, b in chunks(texts):
                    gram, n = np.unique(grams(texts[a:b])[0], return_counts=True)
                    yield pd.DataFrame({"lang": pd.Series([lang] * len(gram), dtype=object), "gram": gram.view(np.int64), "n": n})

    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    found = rows.mapInPandas(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame) -> dict:
    """Model of the training rows (`lang, text`): language -> for each order, arrays of grams and of contexts."""
    spark = rows.sparkSession
    tune(spark)
    level = stored(gram_counts(rows), "grams")
    model: dict = {}
    for order in range(ORDER, 0, -1):
        counts = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"))
        context = F.shiftrightunsigned("gram", 16)
        held = level.withColumn("context", context).join(F.broadcast(counts), "lang")  # one row a language
        discount = (F.col("one") + 1) / (F.col("one") + 2 * F.col("two") + 2)
        sums = held.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.first(discount).alias("discount"))
        value = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
        of_grams = held.join(sums, ["lang", "context"]).select("lang", F.lit(0).alias("kind"), F.col("gram").alias("h"), value.alias("p"))
        weight = F.col("discount") * F.col("kinds") / F.col("total")
        of_contexts = sums.select("lang", F.lit(1).alias("kind"), F.col("context").alias("h"), weight.alias("p"))
        table = of_grams.unionByName(of_contexts).withColumn("p", F.col("p").cast("float")).toPandas()
        for (lang, kind), part in table.groupby(["lang", "kind"]):
            h = part["h"].to_numpy(np.int64).view(np.uint64)
            at = np.argsort(h)
            model.setdefault(lang, {})[order, kind] = h[at], part["p"].to_numpy(np.float32)[at]
        if order > 1:
            lower = level.select("lang", _suffix("gram", order - 1).alias("gram"))
            level = stored(lower.groupBy("lang", "gram").agg(F.count("*").alias("n")), "grams")
    return model


def _lookup(table: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, missing: float) -> np.ndarray:
    if table is None or not len(table[0]):
        return np.full(len(keys), missing)
    known, values = table
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], missing)


def information(model: dict, lang: str, gram: np.ndarray) -> np.ndarray:
    """Bits that each gram's last character carries after the others."""
    tables, p = model[lang], np.full(len(gram), UNIFORM)
    for order in range(1, ORDER + 1):
        own = gram & np.uint64((1 << (16 * order)) - 1)
        weight = _lookup(tables.get((order, 1)), own >> np.uint64(16), 1.0)
        p = np.minimum(_lookup(tables.get((order, 0)), own, 0.0) + weight * p, 1.0)
    return -np.log2(np.maximum(p, 1e-12))


def cross_entropies(model: dict, texts: list[str]) -> np.ndarray:
    """Bits a character of each text in each language, in the order of their names."""
    out = np.full((len(texts), len(model)), np.inf)
    for a, b in chunks(texts):
        gram, doc = grams(texts[a:b])
        kinds, inverse = np.unique(gram, return_inverse=True)
        size = np.maximum(np.bincount(doc, minlength=b - a), 1)
        for k, lang in enumerate(sorted(model)):
            out[a:b, k] = np.bincount(doc, information(model, lang, kinds)[inverse], b - a) / size
    return out


def _measured(rows: DataFrame, model: dict, text_col: str) -> DataFrame:
    """`rows` with `lang_pred, cross_entropy, strength`; all null for texts without a letter."""
    langs = sorted(model)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(series: pd.Series) -> pd.DataFrame:
        texts = [x if isinstance(x, str) and has_letter(x) else None for x in series]
        out = pd.DataFrame({"lang_pred": pd.Series([None] * len(texts), dtype=object), "cross_entropy": np.nan, "strength": np.nan})
        some = [i for i, x in enumerate(texts) if x is not None]
        if some and langs:
            h = cross_entropies(shared.value, [texts[i] for i in some])
            order = np.argsort(h, axis=1, kind="stable")
            best = np.take_along_axis(h, order[:, :1], 1)[:, 0]
            margin = np.take_along_axis(h, order[:, 1:2], 1)[:, 0] - best if len(langs) > 1 else np.full(len(some), 8.0)
            size = np.array([len(texts[i]) for i in some])
            out.loc[some, "lang_pred"] = [langs[k] for k in order[:, 0]]
            out.loc[some, "cross_entropy"] = best
            out.loc[some, "strength"] = margin * np.sqrt(size)
        return out

    udf = F.pandas_udf(run, "lang_pred string, cross_entropy double, strength double", F.PandasUDFType.SCALAR)
    return rows.withColumn("m", udf(F.col(text_col))).select(*rows.columns, "m.*").drop(text_col)


def _bin(strength: Column) -> Column:
    return F.least(F.floor(8 * F.log2(1 + strength)), F.lit(BINS - 1)).cast("int")


def calibration(found: DataFrame) -> list[float]:
    """Probability that the winner is right for each bin of strength: rows of `lang, lang_pred, strength`.

    Bins hold counts with a prior of one right and one wrong row; neighbours are pooled until probabilities ascend.
    """
    rows = found.where("lang IS NOT NULL AND lang_pred IS NOT NULL").groupBy(_bin(F.col("strength")).alias("bin"))
    counts = {r["bin"]: (r["good"], r["n"]) for r in rows.agg(F.count_if(F.col("lang") == F.col("lang_pred")).alias("good"), F.count("*").alias("n")).collect()}
    pools: list[list[float]] = []  # good, rows, bins; at most BINS of them
    for b in range(BINS):
        good, n = counts.get(b, (0, 0))
        pools.append([good + 0.5, n + 1.0, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            good, n, bins = pools.pop()
            pools[-1] = [pools[-1][0] + good, pools[-1][1] + n, pools[-1][2] + bins]
    return [good / n for good, n, bins in pools for _ in range(int(bins))]


def identify(docs: DataFrame, train: Column, lang_col: str = "lang", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, `lang_pred`, `score`, `cross_entropy`, `rejected` of every row, learned from the rows that `train` names."""
    model = fit(docs.where(train).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    names = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*names, F.when(train, F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).alias("text"))
    found = stored(_measured(rows, model, "text"), "measured")
    chances = F.array(*map(F.lit, calibration(found)))
    usual = found.where("lang = lang_pred").groupBy("lang_pred").agg(
        (F.mean("cross_entropy") + REJECT_SD * F.coalesce(F.stddev("cross_entropy"), F.lit(0.0))).alias("limit")
    )
    found = found.join(F.broadcast(usual), "lang_pred", "left")  # one row a language
    known = F.col("lang_pred").isNotNull()
    score = F.when(known, F.element_at(chances, _bin(F.col("strength")) + 1)).otherwise(0.0)
    beyond = ~known | F.col("limit").isNull() | (F.col("cross_entropy") > F.col("limit")) | (score < 0.5)
    return found.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.coalesce("lang_pred", F.lit(UNDECIDED)).alias("lang_pred"),
        score.alias("score"), F.when(known, F.col("cross_entropy")).alias("cross_entropy"), beyond.alias("rejected"),
    )
