"""Exact top-k inner products over an impact-ordered index, a score at a time (operator 7).

Index. Vectors become integers and are held in blocks. A block's postings (dimension, vector, value) stand in order of
descending impact, the absolute value, in segments of a few levels; nothing is left out.

Search. A block of queries meets a block of the index. Segments are added to all scores level by level, from the highest
impact down. What the lower levels can still add to a score is bounded twice: by the norm of the query and what is left of
the vector's (Cauchy-Schwarz), and by the query's absolute sum times the next impact. Vectors whose score and bound stay
below the k-th proven score can't be members. Once few enough are left, or no level is, those are rescored exactly, in
integers; scores proven in one block of the index also hold in the next that the same query block meets.

Both tables are cut into blocks of fixed size, and pairs of blocks are what is dealt out, so memory is that of one pair and
no vector, however often it occurs, makes a task larger. Work is queries times vectors by nature of the question.

Defined results: rows of null id, null vectors and vectors with null, NaN or infinite components take no part; shorter
vectors count as zero in the missing dimensions; all rows of a query's own id are left out of its answer; a repeated query
row is answered again; ties go to the smaller id; empty tables give no rows. Scores must fit into 64 bits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.llm.common import stored, tune

INDEX_BLOCK, QUERY_BLOCK = 2048, 256
#: Pairs of blocks that a worker holds at a time.
BATCH_PAIRS = 8
LEVELS = 4
#: Rescore once this many times k candidates are left on average.
FEW = 4


def as_integers(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def valid(vector: Column) -> Column:
    """Vectors of finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite)


class Index:
    """Postings of a block in impact order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.shape = ids, vectors.shape
        vector, dim = np.nonzero(vectors)
        value = vectors[vector, dim]
        order = np.argsort(-np.abs(value), kind="stable")
        narrow = np.int16 if np.abs(value).max(initial=0) < 1 << 15 else np.int64
        self.vector, self.dim, self.value = vector[order].astype(np.uint16), dim[order].astype(np.uint16), value[order].astype(narrow)
        impact = np.abs(value[order])
        # levels end where the impact falls, so that equal impacts share one
        cuts = [np.searchsorted(-impact, -impact[len(impact) * k // LEVELS], side="right") for k in range(1, LEVELS)] if len(impact) else []
        self.cuts = sorted({0, *map(int, cuts), len(impact)})

    def levels(self) -> Iterator[tuple[np.ndarray, int]]:
        """Each level as a matrix of its postings, with the highest impact below it."""
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            part = np.zeros(self.shape, np.int64)
            part[self.vector[a:b], self.dim[a:b]] = self.value[a:b]
            yield part, abs(int(self.value[b])) if b < len(self.value) else 0


def search(index: Index, ids: np.ndarray, queries: np.ndarray, k: int, proven: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Query row, scores and ids of all that can be among its first k, given the scores `proven` already."""
    n, width = index.shape
    dims = min(width, queries.shape[1])
    queries = queries[:, :dims]
    most = float(np.abs(queries).sum(axis=1).max(initial=0)) * float(np.abs(index.value[:1].astype(np.int64)).max(initial=0))
    kind = np.float32 if most < 1 << 23 else np.float64
    q = queries.astype(kind)
    norm, absolute = np.sqrt((q.astype(float) ** 2).sum(axis=1)), np.abs(q.astype(float)).sum(axis=1)
    own = ids[:, None] == index.ids[None, :]
    whole, left = np.zeros(index.shape, np.int64), np.zeros(n)
    np.add.at(left, index.vector, index.value.astype(float) ** 2)
    scores, possible, floor = np.zeros((len(q), n), kind), ~own, proven.astype(float)
    exact = most < 1 << 52
    for part, below in index.levels():
        whole += part
        scores += q @ part[:, :dims].astype(kind).T
        left = np.maximum(left - (part.astype(float) ** 2).sum(axis=1), 0)
        slack = np.minimum(norm[:, None] * np.sqrt(left)[None, :], (absolute * below)[:, None]) * (1 + 1e-6)
        if not exact:
            slack = slack + 1e-12 * most
        if n > k:
            lowest = np.where(own, -np.inf, scores - slack)
            floor = np.maximum(floor, np.partition(lowest, n - k, axis=1)[:, n - k])
        possible = (scores + slack >= floor[:, None]) & ~own
        if possible.sum() <= FEW * k * len(q):
            break
    # vectors of levels not reached are needed whole for the exact scores
    np.copyto(whole, 0)
    whole[index.vector, index.dim] = index.value
    for i in range(len(q)):
        member = np.flatnonzero(possible[i])
        yield i, whole[member, :dims] @ queries[i], index.ids[member]


def _blocks(size: int, kind: str):
    """Rows (`id`, `v`) to blocks of at most `size`: a name, the ids and the pickled block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []
        rows = 0

        def block(frame: pd.DataFrame) -> pd.DataFrame:
            nonlocal n
            width = max(map(len, frame["v"]), default=0)
            vectors = np.zeros((len(frame), width), np.int64)
            for i, v in enumerate(frame["v"]):
                vectors[i, : len(v)] = v
            ids = frame["id"].to_numpy(np.int64)
            body = Index(ids, vectors) if kind == "index" else (ids, vectors)
            n += 1
            return pd.DataFrame({"block": [task * 1_000_000_000 + n], "body": [pickle.dumps(body)]})

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            while rows >= size:
                frame = pd.concat(held, ignore_index=True)
                yield block(frame.iloc[:size])
                held, rows = [frame.iloc[size:]], rows - size
        if rows:
            yield block(pd.concat(held, ignore_index=True))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each row that `is_query`, the k highest scores among the rows of other ids."""
    tune(vectors.sparkSession, BATCH_PAIRS)
    good = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
    rows = good.select(F.col(id_col).cast("long").alias("id"), as_integers(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
    index = stored(rows.select("id", "v").mapInPandas(_blocks(INDEX_BLOCK, "index"), "block long, body binary"), "index")
    asked = stored(rows.where("q").select("id", "v").mapInPandas(_blocks(QUERY_BLOCK, "query"), "block long, body binary"), "queries")
    shards = max(1, index.count())
    shard = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")
    index = index.select(shard.alias("shard"), F.col("body").alias("index_body"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "body")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = asked.repartition(n, "shard").hint("merge").join(index.repartition(n, "shard"), "shard")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, queries, best = None, None, None, []

        def done() -> pd.DataFrame:
            rows = [(now, i, int(ids[i]), int(v), int(s)) for i, (ss, vs) in enumerate(best) for s, v in zip(ss, vs, strict=True)]
            return pd.DataFrame(rows, columns=["block", "row", "query_id", "vec_id", "score"])

        for batch in batches:
            for block, body, other in zip(batch["block"], batch["body"], batch["index_body"], strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, (ids, queries) = block, pickle.loads(body)
                    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
                proven = np.array([ss[-1] if len(ss) == k else -np.inf for ss, _ in best], float)
                for i, ss, vs in search(pickle.loads(other), ids, queries, k, proven):
                    ss, vs = np.concatenate([best[i][0], ss]), np.concatenate([best[i][1], vs])
                    order = np.lexsort((vs, -ss))[:k]
                    best[i] = ss[order], vs[order]
        if now is not None:
            yield done()

    found = pairs.select("block", "body", "index_body").mapInPandas(run, "block long, row int, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
