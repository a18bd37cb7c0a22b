"""Sharding by weighted rendezvous hashing (operator 4).

Every (key, shard) has a draw, and a row goes to the shard with the best of its draws, `-weight / ln(u)`. A new shard only
adds draws, so it takes rows from the others and moves none between them; a shard of twice the weight gets twice the rows.

`assign` is a column expression. `write_shards` lays the rows out as one folder per shard; a row's slot is its place in its
shard, counted over the written files, so no shard is ever sorted or numbered in one task, and no key gathers rows: what
is dealt out is (shard, part), with as many parts as the row count asks for.

Defined results: a null key has draws of its own, alike for all rows of null key; repeated rows meet in one shard in slots
of their own; a table without rows gives none; columns that clash with those added are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pactline.llm.common import new_path

#: Rows of a written part.
PART_ROWS = 250_000
ADDED = ("shard", "slot", "grown_shard")


def assign(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among `len(weights)` shards."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a weight above zero")
    draws = []
    for shard, weight in enumerate(weights):
        drawn = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
        uniform = (drawn + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((F.lit(-float(weight)) / F.log(uniform)).alias("draw"), F.lit(shard).alias("shard")))
    return F.array_max(F.array(*draws))["shard"]


def write_shards(docs: DataFrame, key_col: str, weights: Sequence[float], path: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Write `docs` in shards and return the written rows with `shard`, `slot` and `grown_shard`.

    `grown_shard` is the shard with one more shard, of the mean weight.
    """
    if clash := set(ADDED) & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are added by sharding")
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    parts = max(1, -(-docs.count() // (part_rows * len(weights))))
    grown = [*weights, sum(weights) / len(weights)]
    laid = docs.withColumns({"shard": assign(F.col(key_col), weights), "grown_shard": assign(F.col(key_col), grown)})
    # rows are dealt to the parts of a shard in turn, so that no key or run of rows decides their sizes
    laid = laid.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    tasks = min(parts * len(weights), int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    laid.repartition(tasks, "shard", "_part").drop("_part").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return read_shards(docs, path)


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The written rows; slots count from 0 over a shard's files in the order of their names."""
    schema = StructType([*docs.schema, StructField("grown_shard", IntegerType()), StructField("shard", IntegerType())])
    rows = docs.sparkSession.read.schema(schema).parquet(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    sizes = rows.groupBy("shard", "_file").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_file")) - F.col("_n")
    base = sizes.select("_file", before.alias("_before"))
    return rows.join(base, "_file").withColumn("slot", F.col("_before") + F.col("_at")).drop("_file", "_at", "_before")
