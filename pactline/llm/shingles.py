"""Near copies by exact Jaccard similarity of word shingles: the links of the pipeline's near-dedup stage.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. No link is missed:

1. A text becomes the set of its shingles' 64-bit hashes. Equal sets become one node before anything is compared.
2. Prefix filter: in any one order of all shingles, two sets that reach the threshold share one among the first fifth of
   each. The order has the shingles that a sample of the texts finds often last. The sample steers the order, so the work,
   and not the result.
3. The fingerprints of operator 2 and its bit-sliced comparison bring the first candidates: nodes of equal fingerprints, and
   of fingerprints within four bits. They find the closest copies only, so the prefix filter adds what they miss.
   Nodes that share a shingle of their prefixes are candidates, unless their sizes or their places in the order exclude the
   threshold. First neighbours by size are compared, then each member with its group's centre, and components are formed
   after each; last come the pairs that are not in one component yet. So a large group of near copies costs about its size
   and not its square. Large groups are cut into parts, and no task holds more than two parts.
4. A bit map of each set shows pairs that differ too much: a bit that one has alone is a shingle that one has alone. That is
   tested where the pair is found. What is left is verified: the sets of both are made again from the texts and intersected.

Words are what operator 2 takes for words: split at ASCII white space, ASCII letters lower-cased. A text of one to four
words is one shingle. Defined results: texts without a word, null ones among them, are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import stored, tune
from pactline.llm.simhash import _joined, components, fingerprint_column, labelled, links, one_of_each

N_WORDS = 5
#: Jaccard similarity of 4/5 or more, in whole numbers so that the threshold itself is met.
OVER, UNDER = 4, 5
#: One text in so many tells which shingles are frequent, if it finds them in `OFTEN` texts or more; at most `MAX_FREQUENT` of them.
SAMPLE, OFTEN, MAX_FREQUENT = 32, 3, 200_000
#: Bits in which the fingerprints of candidates may differ, as operator 2 has it.
RADIUS = 4
#: Bits of the map that spares most texts without candidates from being read into sets again.
MAP_BITS = 24
BATCH_ROWS = 50_000
#: Members of a group that are compared with each other in a task; larger groups are dealt to pairs of such parts.
PART_ROWS = 2_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None, n_words: int = N_WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    single = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(n_words, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        part = single[i : len(single) - k + 1 + i] * _FACTORS[i % len(_FACTORS)]
        h = (h ^ part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def frequent(docs: DataFrame, text_col: str, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample share, ascending, and in how many of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"g": shingles(_text(text), n_words).view(np.int64)})

    texts = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = texts.mapInPandas(run, "g long").groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    counts = stored(counts, "frequent")
    least, held = OFTEN, 0
    for row in counts.groupBy("n").agg(F.count("*").alias("kinds")).orderBy(F.desc("n")).collect():
        held += row["kinds"]
        if held > MAX_FREQUENT:
            least = row["n"] + 1
            break
    table = counts.where(F.col("n") >= least).toPandas()
    g, n = table["g"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(np.int64)
    order = np.argsort(g)
    return g[order], n[order]


def prefix(found: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a set's shingles, rare ones before frequent ones: so many that a similar set must share one."""
    if not len(found):
        return found
    size = len(found) - -(-OVER * len(found) // UNDER) + 1
    g, n = often
    rank = np.zeros(len(found), np.int64)
    if len(g):
        at = np.minimum(np.searchsorted(g, found), len(g) - 1)
        rank = np.where(g[at] == found, n[at], 0)
    return found[np.lexsort((found, rank))[:size]]


def bit_map(found: np.ndarray) -> bytes:
    """A bit for each value of the sets' low bits; two to four bits a shingle."""
    size = 1 << max(3, (2 * len(found)).bit_length())
    marks = np.zeros(size, bool)
    marks[(found & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def may_be_similar(n: int, left: bytes, m: int, right: bytes) -> bool:
    """False only for sets of `n` and `m` shingles below the threshold, by their bit maps."""
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))  # both maps by as many low bits
    common = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return (OVER + UNDER) * common >= OVER * (n + m)


def _sets(text: Column, often: tuple[np.ndarray, np.ndarray], n_words: int, spark) -> Column:
    """`fp`, a hash of the set, its size `n`, its bit map and its prefix."""
    shared = spark.sparkContext.broadcast(often)

    def run(series: pd.Series) -> pd.DataFrame:
        sets = [shingles(_text(x), n_words) for x in series]
        fp = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
        return pd.DataFrame({
            "fp": fp, "n": [len(x) for x in sets], "bits": pd.Series(map(bit_map, sets), dtype=object),
            "prefix": pd.Series([prefix(x, shared.value).view(np.int64) for x in sets], dtype=object),
        })

    return F.pandas_udf(run, "fp long, n int, bits binary, prefix array<long>", F.PandasUDFType.SCALAR)(text)


def _by_group(rows: DataFrame, keys: Sequence[str], found: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """`found` over frames of whole groups of equal keys, their members by size."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size < BATCH_ROWS:
                continue
            frame = pd.concat(held, ignore_index=True)
            ends = np.flatnonzero((frame[keys].to_numpy() != frame[keys].to_numpy()[-1]).any(axis=1))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # all but the last group is complete
            if cut:
                yield from found(frame.iloc[:cut].reset_index(drop=True))
            held, size = [frame.iloc[cut:]], len(frame) - cut
        if size:
            yield from found(pd.concat(held, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "n", "fp").mapInPandas(run, schema)


def _may_reach(n: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether rows `low` and the larger `high` can reach the threshold if the shingle is the first that they share."""
    both = np.minimum(n[low] - pos[low], n[high] - pos[high])
    return (UNDER * n[low] >= OVER * n[high]) & ((OVER + UNDER) * both >= OVER * (n[low] + n[high]))


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of groups of two or more, each with the next larger one as `next` if the two may be similar.

    Rows come sorted by group and size. A large group may be cut into partitions: a partition's first and last row stay
    even if they stand alone in it, and neighbours across the cut are left to the later steps.
    """
    held, shared = None, True  # the last row so far, and whether it stays whatever follows
    for batch in batches:
        if not len(batch):
            continue
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        g, n, pos, fp = (frame[c].to_numpy() for c in ("g", "n", "pos", "fp"))
        same = np.flatnonzero(g[1:] == g[:-1])
        joined = same[_may_reach(n.astype(np.int64), pos.astype(np.int64), same, same + 1)]
        other, known, stay = np.zeros(len(g), np.int64), np.zeros(len(g), bool), np.zeros(len(g), bool)
        other[joined], known[joined] = fp[joined + 1], True
        stay[same] = stay[same + 1] = True
        stay[0] |= shared
        nexts = pd.array(other, dtype="Int64")
        nexts[~known] = pd.NA
        rows = np.flatnonzero(stay[:-1])
        if len(rows):
            yield frame.iloc[rows].assign(next=nexts[rows])[["g", "fp", "n", "pos", "next"]]
        held, shared = frame.iloc[-1:], bool(stay[-1])
    if held is not None:
        yield held.assign(next=pd.array([pd.NA], dtype="Int64"))[["g", "fp", "n", "pos", "next"]]


def _all_pairs(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Pairs of a cell of a group that may be similar, by sizes, places and bit maps, and have different labels."""
    keys = frame[["g", "low", "high"]].to_numpy()
    cell = np.append(0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1)))
    fp, label, part, across = (frame[c].to_numpy() for c in ("fp", "label", "part", "across"))
    n, pos, bits = frame["n"].to_numpy(np.int64), frame["pos"].to_numpy(np.int64), frame["bits"].tolist()
    rows, shift, a, b = np.arange(len(cell)), 1, [], []
    while True:
        rows = rows[rows + shift < len(cell)]
        rows = rows[(cell[rows] == cell[rows + shift]) & (UNDER * n[rows] >= OVER * n[rows + shift])]  # sizes ascend
        if not len(rows):
            break
        open_ = rows[(label[rows] != label[rows + shift]) & (~across[rows] | (part[rows] != part[rows + shift]))]
        for i in open_[_may_reach(n, pos, open_, open_ + shift)].tolist():
            if may_be_similar(int(n[i]), bits[i], int(n[i + shift]), bits[i + shift]):
                a.append(fp[i])
                b.append(fp[i + shift])
        if len(a) > BATCH_ROWS:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = [], []
        shift += 1
    if a:
        yield pd.DataFrame({"a": a, "b": b})


def _to_centres(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Each member of a group with the group's centre, `a, b`, where the two may be similar and have different labels.

    The centre is the member that has the most shingles in groups: the text that copies were made of shares them all,
    while a copy's own changes stand in no group. Copies of one text that differ too much from each other so meet there.
    """
    weights = groups.groupBy("fp").agg(F.count("*").alias("weight"))
    rows = groups.join(weights, "fp").join(labels, "fp")
    best = F.max(F.struct("weight", "fp", "n", "pos", "label")).alias("c")
    centres = rows.groupBy("g").agg(best, F.count("*").alias("carried")).select(
        "g", F.col("c.fp").alias("b"), F.col("c.n").alias("m"), F.col("c.pos").alias("at"), F.col("c.label").alias("other"), "carried"
    )
    met = _joined(rows.drop("weight"), centres, "g", groups.count()).where("label != other")
    both = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at"))
    sized = UNDER * F.least("n", "m") >= OVER * F.greatest("n", "m")
    return met.where(sized & ((OVER + UNDER) * both >= OVER * (F.col("n") + F.col("m")))).select(F.col("fp").alias("a"), "b").distinct()


def _cells(groups: DataFrame, labels: DataFrame, maps: DataFrame) -> DataFrame:
    """Members of the groups that hold more than one label, dealt to pairs of parts of some `PART_ROWS` members each."""
    rows = groups.drop("next").join(labels, "fp")
    mixed = rows.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("carried"))
    mixed = mixed.where("lo != hi").select("g", F.ceil(F.col("carried") / PART_ROWS).alias("parts"), "carried")
    rows = _joined(rows, mixed, "g", groups.count())
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumns({"low": F.least("part", "with"), "high": F.greatest("part", "with")})
    rows = rows.select("g", "low", "high", "part", (F.col("low") != F.col("high")).alias("across"), "fp", "n", "pos", "label")
    return rows.join(maps.select("fp", "bits"), "fp")


def _possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Those of the pairs `a, b` that their bit maps don't exclude."""

    def test(n: pd.Series, left: pd.Series, m: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([may_be_similar(*row) for row in zip(n, left, m, right, strict=True)], dtype=bool)

    rows = pairs.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b")
    return rows.where(F.pandas_udf(test, "boolean", F.PandasUDFType.SCALAR)("n", "x", "m", "y")).select("a", "b")


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """Candidates `a, b` by operator 2: nodes `fp` whose fingerprints `print` are equal or within its radius.

    The first node of a fingerprint stands for it, and the comparison gives forests, so there are about as many pairs as
    nodes; pairs of one group that its forest leaves out come from the prefix filter.
    """
    rows = stored(rows.select("print", "fp").distinct(), "printed")
    prints = stored(rows.groupBy("print").agg(F.min("fp").alias("first"), F.count("*").alias("carried")), "prints")
    own = _joined(rows, prints, "print", rows.count()).select(F.col("fp").alias("a"), F.col("first").alias("b"))
    near = stored(links(prints.select(F.col("print").alias("fp")), RADIUS), "near")
    first = prints.select("print", "first")
    right = near.groupBy("b").agg(F.count("*").alias("carried")).join(first.toDF("b", "right"), "b")
    near = _joined(near, right, "b", near.count()).join(first.toDF("a", "left"), "a")
    return own.unionByName(near.select(F.col("left").alias("a"), F.col("right").alias("b"))).where("a != b")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, n_words: int) -> DataFrame:
    """Those of the pairs `a, b` whose sets reach the threshold. `nodes` has `text_hash` for each `fp`."""
    spark = pairs.sparkSession

    needed = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    needed = stored(needed.join(nodes.select("fp", "text_hash"), "fp"), "needed")
    slots = needed.select(F.col("text_hash").bitwiseAND((1 << MAP_BITS) - 1).cast("int").alias("s")).distinct().toPandas()
    marks = np.zeros(1 << MAP_BITS, bool)
    marks[slots["s"].to_numpy(np.int64)] = True
    shared = spark.sparkContext.broadcast(np.packbits(marks))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = batch["text_hash"].to_numpy(np.int64) & ((1 << MAP_BITS) - 1)
            batch = batch[np.unpackbits(shared.value).view(bool)[slot]].drop_duplicates("text_hash")
            members = [shingles(_text(x), n_words).tobytes() for x in batch["text"]]
            yield pd.DataFrame({"text_hash": batch["text_hash"].to_numpy(), "members": pd.Series(members, dtype=object)})

    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    made = texts.mapInPandas(sets, "text_hash long, members binary").dropDuplicates(["text_hash"])
    made = stored(made.join(needed, "text_hash").select("fp", "members"), "sets")

    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            out.append((OVER + UNDER) * common >= OVER * (len(x) + len(y)))
        return pd.Series(out, dtype=bool)

    test = F.pandas_udf(similar, "boolean", F.PandasUDFType.SCALAR)
    rows = pairs.join(made.toDF("a", "x"), "a").join(made.toDF("b", "y"), "b")
    return stored(rows.where(test("x", "y")).select("a", "b"), "similar")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS) -> DataFrame:
    """One row of each group that links of similar texts join: that of the smallest id, as `simhash.keep_one` has it."""
    spark = tune(docs.sparkSession)
    often = frequent(docs, text_col, n_words)
    made = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), fingerprint_column(F.col(text_col)).alias("print"),
        _sets(F.col(text_col), often, n_words, spark).alias("s"),
    )
    rows = stored(made.select("id", "text_hash", "print", "s.*"), "shingled")
    nodes = rows.groupBy("fp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    postings = nodes.select("fp", "n", F.posexplode("prefix").alias("pos", "g")).select("g", "fp", "n", "pos")
    ranged = postings.repartitionByRange("g", "n", "fp").sortWithinPartitions("g", "n", "fp")
    groups = stored(ranged.mapInPandas(_neighbours, "g long, fp long, n int, pos int, next long"), "groups")
    facts = F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("bits").alias("bits")
    texts = stored(rows.groupBy("fp").agg(*facts), "nodes")

    def checked(pairs: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """All pairs compared so far, and the links among the new ones."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs if known is None else pairs.join(known, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        return pairs if known is None else known.union(pairs), verified(pairs, texts, docs, text_col, n_words)

    def labels() -> DataFrame:
        found = components(edges).select(F.col("node").alias("fp"), "label")
        return stored(texts.select("fp").join(found, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "labels")

    maps = texts.select("fp", "n", "bits")
    pairs = groups.where("next IS NOT NULL").select(F.col("fp").alias("a"), F.col("next").alias("b"))
    pairs = by_fingerprint(rows).unionByName(pairs).distinct()
    known, edges = checked(_possible(pairs, maps), None)
    known, more = checked(_possible(_to_centres(groups.drop("next"), labels()), maps), known)
    edges = edges.union(more)
    pairs = _by_group(_cells(groups, labels(), maps), ["g", "low", "high"], _all_pairs, "a long, b long")
    _, more = checked(pairs, known)
    return one_of_each(docs, labelled(rows.select("id", "fp", "text_hash"), edges.union(more)), id_col, text_col)
