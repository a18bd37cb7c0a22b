"""SimHash near-duplicates by bit-sliced comparison (operator 2).

Steps, each a Spark job whose data stays distributed:

1. A fingerprint per text, in one map.
2. Equal fingerprints become one node before anything is compared, so copies cost no comparison.
3. Candidates: fingerprints are cut into `radius + 2` fields. Two that differ in at most `radius` bits agree in two whole
   fields at least, so they meet below one of the pairs of fields; nothing within the radius is missed.
4. Rows of equal fields lie side by side, 64 to a machine word, one word per bit position. A whole row of comparisons (each
   fingerprint with the one `s` places further) is then a few bitwise operations for each bit position: a carry-save
   counter of three bits and an overflow bit. Words in which every comparison is beyond the radius are given up.
   Fields that very many fingerprints share are cut into parts, and each pair of parts is a piece of work of its own.
5. A task sends a spanning forest of the links it found, never all pairs; connected components join the forests.

Defined results: a null text, or one without a word, has fingerprint zero, linked like any other; rows of null id get the
component of their fingerprint but lend it no id (null if no row has one); repeated rows share a component; a table
without rows gives none. Only the id and text columns are read; names of other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import discard, new_path, stored, tune, unused

BITS = 64
#: Fingerprints that share two fields are compared in parts of at most this many.
PART_ROWS = 16_384
#: Groups up to this size are compared many at once; a larger one block by block.
SMALL_GROUP, QUERY_ROWS = 64, 64
#: A key that over one in this many rows carries is joined by broadcast; there can't be more of them than about this.
HOT_SHARE = 1000


def fingerprint(text: str | None, n_words: int, seed: int = 42) -> int:
    """Majority of the bits of the hashes of all word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n_words, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=False)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprint_column(text: Column, n_words: int = 4, seed: int = 42) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    def run(series: pd.Series) -> pd.Series:
        values = [fingerprint(x if isinstance(x, str) else None, n_words, seed) for x in series]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    return F.pandas_udf(run, "long", F.PandasUDFType.SCALAR)(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _field_masks(radius: int) -> list[int]:
    edges = np.linspace(0, BITS, radius + 3).round().astype(int).tolist()
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]


def slices(fps: np.ndarray) -> np.ndarray:
    """Fingerprints stored vertically: for each bit position a row of 64-bit words, with one bit of each fingerprint."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.pad(bits, ((0, -len(fps) % 64), (0, 0))).T, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def close(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Bit set where two fingerprints differ in at most `radius` bits (up to 7).

    Each of `left` and `right` has the bit positions first and the words last; what lies between broadcasts.
    """
    shape = np.broadcast_shapes(left.shape[1:], right.shape[1:])
    words = np.arange(shape[-1])
    one, two, four, more = (np.zeros(shape, np.uint64) for _ in range(4))

    def part(x: np.ndarray, b: int) -> np.ndarray:
        return x[b] if x.shape[-1] == 1 else x[b][..., words]

    for k in range(0, BITS, 8):
        for b in range(k, k + 8):
            carry = part(left, b) ^ part(right, b)
            carry, one = one & carry, one ^ carry
            carry, two = two & carry, two ^ carry
            carry, four = four & carry, four ^ carry
            more |= carry
        within = ~(more | _over(one, two, four, radius))
        open_ = np.flatnonzero(within.reshape(-1, within.shape[-1]).any(axis=0))
        if len(open_) < len(words):  # all comparisons in the other words are beyond the radius
            words, one, two, four, more = words[open_], one[..., open_], two[..., open_], four[..., open_], more[..., open_]
        if not len(words):
            break
    out = np.zeros(shape, np.uint64)
    out[..., words] = ~(more | _over(one, two, four, radius))
    return out


def _over(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Counters above the radius."""
    over = np.zeros_like(one)
    for value in range(radius + 1, 8):
        over |= (one if value & 1 else ~one) & (two if value & 2 else ~two) & (four if value & 4 else ~four)
    return over


def _set_bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def _forest_of_large(fps: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """The smallest row that each row of one group is joined to: blocks of fingerprints against all words of the group."""
    left = np.flatnonzero(side != 2)
    right = np.flatnonzero(side != 1)
    labels, planes = np.arange(len(fps)), slices(fps[right])
    positions = np.arange(BITS, dtype=np.uint64)[:, None, None]
    for at in range(0, len(left), QUERY_ROWS):
        rows = left[at : at + QUERY_ROWS]
        mask = np.uint64(0) - ((fps[rows][None, :, None] >> positions) & np.uint64(1))
        near = close(mask, planes[:, None, :], radius)
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            joined = np.append(right[_set_bits(near[k], len(right))], rows[k])
            found = labels[joined]
            if (found != found[0]).any():
                kinds = np.unique(found)
                labels[np.isin(labels, kinds)] = kinds[0]
    return labels


def _forest_of_small(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """The same over many small groups at once: each fingerprint with the one `shift` places on, for every shift."""
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows, shift = np.arange(len(fps)), 1
    while True:
        rows = rows[rows + shift < len(fps)]
        rows = rows[group[rows] == group[rows + shift]]
        if not len(rows):
            break
        pairs = rows[(side[rows] == 0) | (side[rows] != side[rows + shift])]
        if len(pairs):
            near = close(slices(fps[pairs]), slices(fps[pairs + shift]), radius)
            for i in pairs[_set_bits(near, len(pairs))].tolist():
                a, b = root(i), root(i + shift)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        shift += 1
    return np.array([root(i) for i in range(len(fps))], np.int64)


def linked(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside groups: each fingerprint in a link, and one it is joined to.

    `group` ascends. `side` is 0 where a whole group is compared; a piece of work between two parts holds 1 and 2, and only
    pairs of different sides are taken.
    """
    if not len(fps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(fps)))
    roots = np.arange(len(fps))
    small = np.flatnonzero(np.repeat(sizes <= SMALL_GROUP, sizes))
    if len(small):
        roots[small] = small[_forest_of_small(fps[small], group[small], side[small], radius)]
    for a, n in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist(), strict=True):
        roots[a : a + n] = a + _forest_of_large(fps[a : a + n], side[a : a + n], radius)
    inner = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[inner].view(np.int64), fps[roots[inner]].view(np.int64)


def links(nodes: DataFrame, radius: int, part_rows: int = PART_ROWS) -> DataFrame:
    """`a, b`: links between the distinct fingerprints `fp`, as spanning forests of the pieces of work."""
    masks = _field_masks(radius)
    keys = [F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(_signed(x | y))).alias("bits")) for i, (x, y) in enumerate(combinations(masks, 2))]
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.pair", "k.bits")
    counts = rows.groupBy("pair", "bits").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part_rows).cast("int")
    work = rows.join(counts, ["pair", "bits"]).withColumn("parts", parts)
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    work = work.withColumn("own", own).select(
        "fp", "pair", "bits", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    )
    work = work.select(
        "fp", "pair", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    place = ["pair", "bits", "low", "high"]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.repartition(n, *place).sortWithinPartitions(*place, "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def found(frame: pd.DataFrame) -> pd.DataFrame:
            values = frame[place].to_numpy()
            group = np.concatenate([[0], np.cumsum((values[1:] != values[:-1]).any(axis=1))])
            a, b = linked(frame["fp"].to_numpy(np.int64).view(np.uint64), group, frame["side"].to_numpy(), radius)
            return pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size < part_rows:
                continue
            frame = pd.concat(held, ignore_index=True)
            values = frame[place].to_numpy()
            ends = np.flatnonzero((values != values[-1]).any(axis=1))  # all but the last group is complete
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield found(frame.iloc[:cut].reset_index(drop=True))
            held, size = [frame.iloc[cut:]], len(frame) - cut
        if size:
            yield found(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(compare, "a long, b long").distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _joined(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` joined with `facts`: one row for each `key`, and in `carried` how many of `rows` have it.

    Keys that over one in `HOT_SHARE` of `total` rows carry are joined by broadcast, where the rows lie; there are about
    `HOT_SHARE` of them at most, whatever the input.
    """
    hot = facts.where(F.col("carried") * HOT_SHARE > F.lit(total)).drop("carried")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.drop("carried"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """`node, label`: the smallest node that each node of an edge can reach.

    Stars: every node points its larger neighbours to its smallest one, then its smaller ones, until nothing moves. Each
    round is two aggregates with map-side partials, and is written to the shared folder. The centre of a large star never
    gathers its neighbours in a task.
    """
    spark = edges.sparkSession
    path = new_path(spark, "links")
    edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a > b").distinct().write.parquet(path)
    smallest = F.min("b").alias("m"), F.count("*").alias("carried")
    while True:
        stars = spark.read.schema("a long, b long").parquet(path)
        total = stars.count()
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(*smallest).withColumn("m", F.least("a", "m"))
        large = _joined(both.where("b > a"), least, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        middle = new_path(spark, "links")
        large.where("a > b").distinct().write.parquet(middle)
        large = spark.read.schema("a long, b long").parquet(middle)
        small = _joined(large, large.groupBy("a").agg(*smallest), "a", total)
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = new_path(spark, "links")
        small.select("e.*").where("a > b").distinct().write.parquet(after)
        discard(spark, middle)
        new = spark.read.schema("a long, b long").parquet(after)
        moved = new.join(stars, ["a", "b"], "left_anti").limit(1).count() + stars.join(new, ["a", "b"], "left_anti").limit(1).count()
        discard(spark, path)
        path = after
        if not moved:
            return new.select(F.col("a").alias("node"), F.col("b").alias("label"))


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, seed: int = 42) -> DataFrame:
    """`id, fp, text_hash` of every row, written once."""
    tune(docs.sparkSession)
    found = docs.select(
        F.col(id_col).cast("long").alias("id"), fingerprint_column(F.col(text_col), n_words, seed).alias("fp"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    return stored(found, "fingerprints")


def near_duplicates(rows: DataFrame, radius: int = 4) -> DataFrame:
    """`rows` of `fingerprinted` with `component_id`, the smallest id that can be reached over links.

    `label`, a fingerprint of the component, names it where ids are null or repeat.
    """
    if not 0 <= radius <= 7:
        raise ValueError("the bit-sliced counter holds radii from 0 to 7")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    return _with_labels(rows, nodes, links(nodes.select("fp"), radius))


def labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """`rows` of `id, fp, text_hash` with the `label` and `component_id` that the links `a, b` between values of `fp` give."""
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    return _with_labels(rows, nodes, edges)


def _with_labels(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    labels = components(edges)
    member = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(nodes["fp"], "least", "n", F.coalesce("label", "fp").alias("label"))
    lowest = member.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("carried"))
    member = _joined(member.drop("least"), lowest, "label", nodes.count())
    member = stored(member.select("fp", "label", "component_id", F.col("n").alias("carried")), "members")
    return _joined(rows, member, "fp", rows.count())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group: that of the smallest id (null ids last); of equal rows, one.

    Rows that share an id but not a text are told apart by their texts.
    """
    return one_of_each(docs, near_duplicates(fingerprinted(docs, id_col, text_col, n_words), radius), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each `label` of `found` (`id, text_hash, label`), the row of `docs` with the smallest id."""
    missing = F.lit(-(1 << 63))
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", missing).alias("key"), F.col("text_hash").alias("hash"))
    key, text = unused(docs, "_key"), unused(docs, "_hash")
    stay = found.groupBy("label").agg(F.min(rank).alias("r")).select(F.col("r.key").alias(key), F.col("r.hash").alias(text))
    stay = stay.distinct()
    names = docs.columns
    marked = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), missing), text: F.xxhash64(text_col)})
    return marked.join(stay, [key, text], "left_semi").dropDuplicates([key, text]).select(*[f"`{c}`" for c in names])
