"""Sets that are contained in others, without comparing pairs.

A set is listed under its rarest member, and met by those others that hold that member. Rarity is counted over the others, so
a frequent member, which a third of them may carry, lists only sets that have nothing rarer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained_in(sets: DataFrame, members: str, holders: DataFrame, held: str) -> DataFrame:
    """Rows of `sets` with every row of `holders` whose array `held` has all of the array `members`.

    Empty sets meet nothing. The column names of the two tables must differ.
    """
    each = holders.withColumn("_member", F.explode(F.array_distinct(held)))
    often = each.groupBy("_member").agg(F.count("*").alias("_often"))
    # A member that nobody holds leaves no row here, so its set comes out one short.
    wanted = sets.select(F.array_distinct(members).alias("_set")).distinct()
    sized = wanted.withColumn("_member", F.explode("_set")).join(often, "_member").groupBy("_set").agg(
        F.min(F.struct("_often", "_member"))["_member"].alias("_member"), F.count("*").alias("_known")
    )
    listed = sets.withColumn("_set", F.array_distinct(members)).join(sized.where(F.col("_known") == F.size("_set")).drop("_known"), "_set")
    met = listed.join(each, "_member").where(F.size(F.array_except("_set", held)) == 0)
    return met.drop("_member", "_set")
