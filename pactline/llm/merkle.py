"""Merkle manifest of a dataset by time-forward processing (operator 12).

Rows are leaves. The leaves of a group, in order, form a tree whose runs of three consecutive nodes become their hash, level by
level, until one node is left: the group's subroot. The subroots, in order of the groups, form one more such tree.

A node's label is (last leaf below it, level), so children stand before their parents. The forward sweep meets the nodes in
that order and delivers each digest to the parent through a priority queue of labels; the reversed sweep starts at the root
and delivers to each child the rest of its way up: its siblings, then what its parent got. Both queues hold a few messages a
level. They are external: a task sweeps over blocks of 243 consecutive leaves (five levels), and messages that leave a block
are rows of a table, which the next shuffle brings, sorted by label, to the block that receives them. So a tree of any size
takes a round for every five levels, a hot group is many blocks, and no task holds more than one block.

Leaves get their places from the written files of a sort by range: a row's place in its file, and counts of earlier files.

Defined results: a null field is `-`; rows of null id stand first in their group, rows of equal id by their leaf, and equal
rows are leaves of their own; a null group is a group and stands before all others; a lone leaf is its subroot, a lone subroot
the root; a table without rows gives none. Only the columns that the caller names are read, whatever else there is.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.llm.common import stored

FAN = 3
BLOCK_LEVELS = 5
#: Rows of a task and of a written file: they are digests, of some hundred bytes.
TASK_ROWS = 100_000

Step = tuple[str, str]


def leaf_hash(fields: Sequence[Column]) -> Column:
    """H of the fields: each `-` if null, else its UTF-8 bytes' count, `:`, and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digest_of(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def width(total: int, level: int) -> int:
    """Nodes of a level of a tree of `total` leaves."""
    return -(-total // FAN**level)


def last_leaf(total: int, level: int, at: int) -> int:
    return min(total, (at + 1) * FAN**level) - 1


def forward(first: int, digests: Sequence[str], total: int, levels: int = BLOCK_LEVELS) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The topmost digest of a block, and the digests that each of its inner nodes, by level and place, received."""
    received: dict[tuple[int, int], list[str]] = {}
    queue: list[tuple[int, int, int, int, str]] = []  # label of the receiver, its place, the sender's place, digest
    top = ""

    def deliver(level: int, at: int, digest: str) -> None:
        nonlocal top
        if level == levels or width(total, level) == 1:
            top = digest
        else:
            heapq.heappush(queue, (last_leaf(total, level + 1, at // FAN), level + 1, at // FAN, at, digest))

    for now, digest in enumerate(digests, first):
        deliver(0, now, digest)
        while queue and queue[0][0] == now:
            _, level, at, _, _ = queue[0]
            given = []
            while queue and queue[0][:3] == (now, level, at):
                given.append(heapq.heappop(queue)[4])
            received[level, at] = given
            deliver(level, at, digest_of(given))
    return top, received


def backward(
    first: int, count: int, total: int, received: dict[tuple[int, int], list[str]], steps: tuple[Step, ...], levels: int = BLOCK_LEVELS
) -> list[tuple[Step, ...]]:
    """The ways up of a block's leaves, given that of its topmost node."""
    found: list[tuple[Step, ...]] = [()] * count
    level = next(k for k in range(levels + 1) if k == levels or width(total, k) == 1)
    at = first // FAN**level
    queue = [(-last_leaf(total, level, at), -level, at, steps)]
    while queue:
        _, level, at, steps = heapq.heappop(queue)
        level = -level
        if not level:
            found[at - first] = steps
            continue
        given = received[level, at]
        for k in range(len(given)):
            step = "".join(given[:k]), "".join(given[k + 1 :])
            child = FAN * at + k
            heapq.heappush(queue, (-last_leaf(total, level - 1, child), 1 - level, child, (step, *steps)))
    return found


def folded(digest: str, steps: Sequence[Step]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in steps:
        digest = digest_of((left, digest, right))
    return digest


def _packed(steps: Sequence[Step]) -> str:
    return ";".join(f"{left},{right}" for left, right in steps)


def _steps(packed: str) -> tuple[Step, ...]:
    return tuple(tuple(x.split(",")) for x in packed.split(";")) if packed else ()


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables in which no block is cut off, with the range of rows of each block."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = list(zip(held["tree"].to_pylist(), held["block"].to_pylist(), strict=True))
        starts = [i for i, key in enumerate(keys) if not i or key != keys[i - 1]]
        if len(starts) > 1:
            yield held.slice(0, starts[-1]).combine_chunks(), list(zip(starts, starts[1:], strict=False))
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), [(0, held.num_rows)]


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def placed(nodes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Nodes (`tree`, the columns of the order and others) with their place `at` in their tree and its size `total`, written;
    and how many tasks they are for."""
    keys = ["tree", *order, "tie"]
    ranged = nodes.withColumn("tie", F.monotonically_increasing_id())
    ranged = stored(ranged.repartitionByRange(*keys).sortWithinPartitions(*keys), "leaves")
    ranged = ranged.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    parts = ranged.groupBy("tree", "file").agg(
        F.min("row").alias("first_row"), F.count("*").alias("n"), F.min(F.struct(*order, "tie")).alias("lead")
    )
    tree = W.partitionBy("tree")  # one row a file
    earlier = F.sum("n").over(tree.orderBy("lead").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("tree", "file", "first_row", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("n").over(tree).alias("total"))
    found = ranged.join(parts, ["tree", "file"]).withColumn("at", F.col("before") + F.col("row") - F.col("first_row"))
    tasks = max(1, -(-ranged.count() // TASK_ROWS))
    return stored(found.drop("file", "row", "first_row", "before", "tie").coalesce(tasks), "placed"), tasks


def _rise(levels: int) -> Callable:
    """The topmost digest of each block, as a node of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ranges in _whole_blocks(batches):
            tree, at, total, digest = (table[c].to_pylist() for c in ("tree", "at", "total", "digest"))
            tops = [forward(at[i], digest[i:j], total[i], levels)[0] for i, j in ranges]
            starts = [i for i, _ in ranges]
            columns = [
                pa.array([tree[i] for i in starts], pa.string()), pa.array([at[i] // FAN**levels for i in starts], pa.int64()),
                pa.array([width(total[i], levels) for i in starts], pa.int64()), pa.array(tops, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "at", "total", "digest"])

    return run


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / FAN**levels))


def rise(leaves: DataFrame, tasks: int, levels: int = BLOCK_LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, from the leaves up, and the topmost digest of every tree with the round that found it."""
    rounds, tops = [_blocked(leaves, levels)], []
    while True:
        sent = _by_block(rounds[-1].select("tree", "block", "at", "total", "digest"))
        sent = stored(sent.mapInArrow(_rise(levels), "tree string, at long, total long, digest string").coalesce(tasks), "nodes")
        tops.append(sent.where("total = 1").select("tree", "digest", F.lit(len(rounds) - 1).alias("round")))
        rest = sent.where("total > 1")
        if rest.isEmpty():
            break
        rounds.append(_blocked(rest, levels))
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return rounds, found


def _descend(add: Callable[[list[tuple[Step, ...]], pa.Table], list[pa.Array]], names: Sequence[str], levels: int) -> Callable:
    """The reversed sweep over blocks, each led by the row (`at` -1) that its topmost node received; `add` gives the columns
    `names` of the leaves from their ways up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ranges in _whole_blocks(batches):
            at, total, digest, packed = (table[c].to_pylist() for c in ("at", "total", "digest", "steps"))
            rows, ways, heads = [], [], []
            for i, j in ranges:
                if at[i] != -1 or j == i + 1:
                    raise RuntimeError("a block without the message of its parent")
                _, received = forward(at[i + 1], digest[i + 1 : j], total[i + 1], levels)
                ways += backward(at[i + 1], j - i - 1, total[i + 1], received, _steps(packed[i]), levels)
                rows += range(i + 1, j)
                heads += [i] * (j - i - 1)
            # the leaves' own columns, with what their blocks received
            own, led = table.take(pa.array(rows)), table.take(pa.array(heads))
            for c in ("subroot", "root"):
                own = own.set_column(own.schema.get_field_index(c), c, led[c])
            own = own.drop_columns(["steps"])
            for name, column in zip(names, add(ways, own), strict=True):
                own = own.append_column(name, column)
            yield from own.combine_chunks().to_batches()

    return run


def _ways(ways: list[tuple[Step, ...]], leaves: pa.Table) -> list[pa.Array]:
    return [pa.array([_packed(w) for w in ways], pa.string())]


def _proofs(ways: list[tuple[Step, ...]], leaves: pa.Table) -> list[pa.Array]:
    proof = [digest_of([x for step in w for x in step]) for w in ways]
    roots = [folded(d, w) for d, w in zip(leaves["presented"].to_pylist(), ways, strict=True)]
    return [pa.array(proof, pa.string()), pa.array(roots, pa.string())]


def _swept(nodes: DataFrame, heads: DataFrame, add: Callable, names: Sequence[str], tasks: int, levels: int) -> DataFrame:
    """Nodes of a round, led by the rows `heads` (`tree, block, steps, subroot, root`), after the reversed sweep."""
    lead = heads.withColumn("at", F.lit(-1).cast("long"))
    both = nodes.unionByName(lead, allowMissingColumns=True)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if f.name != "steps"]
    found = _by_block(both).mapInArrow(_descend(add, names, levels), ", ".join([*kept, *(f"`{n}` string" for n in names)]))
    return found.coalesce(tasks)


def descend(
    rounds: list[DataFrame], tops: DataFrame, add: Callable, names: Sequence[str], tasks: int, levels: int = BLOCK_LEVELS
) -> DataFrame:
    """The leaves with the columns that `add` makes of their ways up; `tops` holds `tree, round, steps, subroot, root`."""
    heads = None
    for k in range(len(rounds) - 1, -1, -1):
        own = tops.where(F.col("round") == k).select("tree", F.lit(0).cast("long").alias("block"), "steps", "subroot", "root")
        heads = own if heads is None else own.unionByName(heads)
        if k:
            down = _swept(rounds[k], heads, _ways, ["steps"], tasks, levels)
            heads = stored(down.select("tree", F.col("at").alias("block"), "steps", "subroot", "root"), "ways")
    return _swept(rounds[0], heads, add, names, tasks, levels)


def manifest(
    docs: DataFrame, leaf: Column, presented: Column | None = None, id_col: str = "doc_id", group_col: str = "source", levels: int = BLOCK_LEVELS
) -> DataFrame:
    """`id, leaf, subroot, root, proof_sha256, folded_root, verified` of every row.

    `leaf` is the digest that the manifest is built of, `presented` the one that is put to the proof (the same if not given).
    A task sweeps blocks of `levels` levels.
    """
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("tree"), F.col(id_col).alias("id"), leaf.alias("digest"),
        (leaf if presented is None else presented).alias("presented"),
    )
    lower, tasks = placed(leaves, ["id", "digest"])
    rounds, subroots = rise(lower, tasks, levels)
    upper, few = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.col("round").alias("rounds")), ["name"])
    upper_rounds, root = rise(upper, few, levels)
    root = root.select("tree", "round", F.lit("").alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    ways = descend(upper_rounds, root, _ways, ["steps"], few, levels)
    tops = stored(ways.select(F.col("name").alias("tree"), F.col("rounds").alias("round"), "steps", F.col("digest").alias("subroot"), "root"), "tops")
    found = descend(rounds, tops, _proofs, ["proof_sha256", "folded_root"], tasks, levels)
    return found.select(
        "id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
