"""Interval union and point-in-interval joins on bucketed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 24 * 60 * 60 * 1000
HOUR_MS = 60 * 60 * 1000


def _merge(df: DataFrame, part: list[str], keep: list[str]) -> DataFrame:
    """Gaps and islands inside `part`: touching intervals become one."""
    by_start = W.partitionBy(*part).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(reach >= F.col("start_ms"), 0).otherwise(1))
    island = F.sum("_new").over(by_start.rowsBetween(W.unboundedPreceding, 0))
    return (
        opened.withColumn("_island", island)
        .groupBy(*part, "_island")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
        .select(*keep, "start_ms", "end_ms")
    )


def union_intervals(df: DataFrame, keys: list[str], bucket_ms: int = DAY_MS) -> DataFrame:
    """Union of `[start_ms, end_ms]` per key.

    Intervals merge inside time buckets first. How far the buckets before one reach, and how many islands they open, are
    running values over one row a bucket; with these every bucket tells by itself which of its islands go on from an earlier
    one and which number each has. So a key's islands are never in one task, however many they are.
    """
    bucketed = df.select(*keys, "start_ms", "end_ms").withColumn("_bucket", F.floor(F.col("start_ms") / bucket_ms))
    part = [*keys, "_bucket"]
    local = _merge(bucketed, part, part)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    reach = local.groupBy(*part).agg(F.max("end_ms").alias("_end")).select(*part, F.max("_end").over(before).alias("_reach"))
    opened = _with_bucket(local, reach, part).withColumn("_new", F.when(F.col("_reach") >= F.col("start_ms"), 0).otherwise(1))
    numbers = opened.groupBy(*part).agg(F.sum("_new").alias("_n")).select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = W.partitionBy(*part).orderBy("start_ms").rowsBetween(W.unboundedPreceding, 0)
    numbered = _with_bucket(opened, numbers, part).withColumn("_island", F.col("_first") + F.sum("_new").over(inside))
    return (
        numbered.groupBy(*keys, "_island")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
        .select(*keys, "start_ms", "end_ms")
    )


def _with_bucket(rows: DataFrame, facts: DataFrame, part: list[str]) -> DataFrame:
    """Rows with the facts of their bucket; a null key is a key."""
    r, f = rows.alias("r"), facts.alias("f")
    same = F.lit(True)
    for k in part:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}"))
    return r.join(f, same).select("r.*", *[f"f.{c}" for c in facts.columns if c not in part])


def join_points(
    points: DataFrame, intervals: DataFrame, keys: list[str], point: str, how: str = "inner", bucket_ms: int = DAY_MS
) -> DataFrame:
    """Points joined to the intervals holding them, as an equi join on (keys, time bucket).

    Each interval is listed under every bucket it touches, each point under one, so only candidates
    of the same bucket meet. `intervals` carries `start_ms`, `end_ms` (inclusive).
    """
    spans = intervals.withColumn(
        "_bucket",
        F.explode(
            F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("end_ms") / bucket_ms))
        ),
    )
    p = points.withColumn("_bucket", F.floor(F.col(point) / bucket_ms)).alias("p")
    s = spans.alias("s")
    cond = F.col(f"p.{point}").between(F.col("s.start_ms"), F.col("s.end_ms"))
    for k in [*keys, "_bucket"]:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    joined = p.join(s, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bucket")
    right = [c for c in intervals.columns if c not in keys]
    return joined.select(*[f"p.{c}" for c in points.columns], *[f"s.{c}" for c in right])


def reach_at(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, bucket_ms: int = DAY_MS) -> DataFrame:
    """Points with `reach`: how far the intervals of their key that start at or before them go; NULL without any.

    Both are rows of one table, ordered inside time buckets; what the buckets before one reach is a running value over one
    row a bucket. So an interval is one row, however long it is. A null key holds nothing.
    """
    none = F.lit(None)
    whole = F.struct(*points.columns)
    asked = points.select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_ask"), none.cast("bigint").alias("_end"), whole.alias("_row"))
    held = intervals.select(*keys, F.col("start_ms").alias("_at"), F.lit(0).alias("_ask"), F.col("end_ms").alias("_end"))
    rows = asked.unionByName(held, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / bucket_ms))
    for k in [*keys, "_at"]:
        rows = rows.where(F.col(k).isNotNull())
    part = [*keys, "_bucket"]
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    earlier = rows.groupBy(*part).agg(F.max("_end").alias("_end")).select(*part, F.max("_end").over(before).alias("_before"))
    inside = W.partitionBy(*part).orderBy("_at", "_ask").rowsBetween(W.unboundedPreceding, 0)
    reached = rows.withColumn("_inside", F.max("_end").over(inside)).where("_ask = 1")
    return reached.join(earlier, part).select("_row.*", F.greatest("_inside", "_before").alias("reach"))


def count_inside(
    spans: DataFrame, counted: DataFrame, keys: list[str], ids: list[str], point: str, bucket_ms: int = HOUR_MS
) -> DataFrame:
    """`keys, ids, n`: how many points lie in the spans `[start_ms, end_ms]` of that name; no `end_ms` is an open end.

    `counted` has `point` and `n`, how many points lie there. A span holds what lies up to its end less what lies before its
    start. Both are running sums, inside time buckets and over one row a bucket; no span meets a point. A null key holds none.
    """
    usable = F.lit(True)
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    sound = spans.where(usable & F.col("start_ms").isNotNull() & (F.col("end_ms").isNull() | (F.col("end_ms") >= F.col("start_ms"))))
    open_end = F.col("end_ms").isNull().alias("_open")
    # At one instant: starts, points, ends.
    starts = sound.select(*keys, *ids, F.col("start_ms").alias("_at"), F.lit(0).alias("_order"), open_end, F.lit(0).cast("bigint").alias("_n"))
    ends = sound.where("end_ms IS NOT NULL").select(*keys, *ids, F.col("end_ms").alias("_at"), F.lit(2).alias("_order"), open_end, F.lit(0).cast("bigint").alias("_n"))
    there = counted.where(usable & F.col(point).isNotNull()).select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_order"), F.col("n").alias("_n"))
    rows = starts.unionByName(ends).unionByName(there, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / bucket_ms))
    part = [*keys, "_bucket"]
    # Later buckets are the ones before, seen from the end: a frame that ends at the last row is computed anew for every row.
    earlier, later = (W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("_bucket"), F.desc("_bucket")))
    zero = F.lit(0).cast("bigint")
    buckets = rows.groupBy(*part).agg(F.sum("_n").alias("_all")).select(
        *part, "_all",
        F.coalesce(F.sum("_all").over(earlier), zero).alias("_before"),
        F.coalesce(F.sum("_all").over(later), zero).alias("_after"),
    )
    inside = W.partitionBy(*part).orderBy("_at", "_order").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("_inside", F.sum("_n").over(inside)).where("_order <> 1").join(buckets, part)
    so_far = F.col("_before") + F.col("_inside")
    share = (
        F.when(F.col("_order") == 2, so_far)
        .when(F.col("_open"), F.col("_all") - F.col("_inside") + F.col("_after"))
        .otherwise(-so_far)
    )
    return placed.groupBy(*keys, *ids).agg(F.sum(share).alias("n"))
