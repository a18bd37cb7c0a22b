"""Top-n per group that survives a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, spread: str | None = None, salts: int = 32
) -> DataFrame:
    """First `n` rows of every group by `order`.

    Spark limits each group before the shuffle (`row_number() <= n`). With `spread`, a column that
    differs between the rows of a group, groups are first cut inside salted parts, so no task ever
    holds more than its share of a hot group; the second step sees at most `salts * n` rows a group.
    """

    def cut(frame: DataFrame, parts: list) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*parts).orderBy(*order))
        return frame.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")

    if spread is not None:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
        df = cut(salted, [*keys, "_salt"]).drop("_salt")
    return cut(df, list(keys))
