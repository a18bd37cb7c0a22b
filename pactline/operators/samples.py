"""Samples of the bus: striped, capped, merged, retained, and what they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.operators.intervals import reach_at, union_intervals
from pactline.operators.ranking import top_n_per_group
from pactline.session import broadcast_checked

# Defaults of the sampling and retention rules.
DEFAULT_STRIPES = 8
GRADED_PER_TYPE = 50
RETAINED_PER_TYPE = 200
RETAINED_TYPES = 500
SNAPSHOT_TTL_DAYS = 30

def _newest():
    return [F.desc("ts"), F.asc("event_id")]



def stripe_ranges(windows: DataFrame, stripes: int = DEFAULT_STRIPES) -> DataFrame:
    """Cut `[start_ms, end_ms)` into contiguous stripes; the last takes the remainder."""
    span = F.col("end_ms") - F.col("start_ms")
    n = F.when((span <= 0) | F.lit(stripes <= 1), F.lit(1)).otherwise(F.least(F.lit(stripes), span)).cast("bigint")
    width = F.floor(span / F.col("_n")).cast("bigint")
    return (
        windows.withColumn("_n", n)
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("stripe"))
        .withColumn("from_ms", F.col("start_ms") + width * F.col("stripe"))
        .withColumn(
            "to_ms",
            F.when(F.col("stripe") == F.col("_n") - 1, F.greatest("end_ms", "start_ms")).otherwise(
                F.col("start_ms") + width * (F.col("stripe") + 1)
            ),
        )
        .drop("_n")
    )


def _striped(df: DataFrame, start_ms: int, end_ms: int, stripes: int) -> DataFrame:
    width = max((end_ms - start_ms) // stripes, 1)
    ms = F.unix_millis(F.col("ts"))
    stripe = F.least(F.floor((ms - start_ms) / width), F.lit(stripes - 1)).cast("int")
    return df.where((ms >= start_ms) & (ms < end_ms)).withColumn("stripe", stripe)


def striped_sample(
    df: DataFrame, start_ms: int, end_ms: int, max_events: int, stripes: int = DEFAULT_STRIPES
) -> DataFrame:
    """At most ceil(max/stripes) oldest events of every stripe, then the newest `max_events`."""
    cap = max(-(-max_events // stripes), 1)
    order = [F.asc("ts"), F.asc("event_id")]
    cut = top_n_per_group(_striped(df, start_ms, end_ms, stripes), ["stripe"], order, cap, spread="event_id")
    return cut.orderBy(*_newest()).limit(max_events)


def cap_per_type(df: DataFrame, n: int = GRADED_PER_TYPE) -> DataFrame:
    """Newest `n` events of every type, with `observed`, the volume before the cap."""
    keys = ["source", "event_type"]
    volume = df.groupBy(*keys).agg(F.count("*").alias("observed"))
    kept = top_n_per_group(df, keys, _newest(), n, spread="event_id")
    return kept.join(broadcast_checked(volume), keys)


def sample_coverage(
    df: DataFrame, start_ms: int, end_ms: int, max_events: int, stripes: int = DEFAULT_STRIPES
) -> DataFrame:
    """One row: events, types, minutes between first and last event, whether a stripe was cut."""
    cap = max(-(-max_events // stripes), 1)
    striped = _striped(df, start_ms, end_ms, stripes)
    per = striped.groupBy("stripe", "source", "event_type").agg(
        F.count("*").alias("n"), F.min(F.unix_millis("ts")).alias("lo"), F.max(F.unix_millis("ts")).alias("hi")
    )
    cut = per.groupBy("stripe").agg(F.sum("n").alias("n")).agg(
        F.coalesce(F.max(F.col("n") > cap), F.lit(False)).alias("truncated")
    )
    totals = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("events"),
        F.countDistinct("source", "event_type").alias("event_types"),
        F.floor((F.max("hi") - F.min("lo")) / 60000).cast("bigint").alias("minutes_covered"),
    )
    # Two one-row results side by side.
    return totals.crossJoin(cut)


def merge_sample(old: DataFrame, new: DataFrame, n: int = RETAINED_PER_TYPE) -> DataFrame:
    """Add a fetch to a retained sample: one row per event id (the held one wins), newest `n` a type."""
    keys = ["channel", "source", "event_type"]
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    once = top_n_per_group(both, [*keys, "event_id"], [F.asc("_batch")], 1)
    return top_n_per_group(once.drop("_batch"), keys, _newest(), n, spread="event_id")


def coverage(fetches: DataFrame, keys: list[str]) -> DataFrame:
    """Islands of complete fetches per key; a truncated fetch covers nothing."""
    return union_intervals(fetches.where(~F.col("truncated")), keys)


def is_covered(cov: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each asked window lies inside one island. Windows carry `window_id`, `from_ms`, `to_ms`."""
    asked = windows.select("window_id", *keys, "from_ms", "to_ms")
    held = reach_at(asked, cov, keys, "from_ms").where(F.col("reach") >= F.greatest("from_ms", "to_ms"))
    return windows.join(held.select("window_id", F.lit(True).alias("covered")), "window_id", "left").fillna(
        False, ["covered"]
    )


def retain(samples: DataFrame, max_types: int = RETAINED_TYPES, max_bytes: int | None = None) -> DataFrame:
    """Types kept: most recently fetched first, up to a count and a byte budget.

    Works on one row per type; the running sum sees at most `max_types` of them.
    """
    per_type = samples.groupBy("source", "event_type").agg(
        F.max("fetched_at").alias("fetched_at"),
        F.count("*").alias("events"),
        F.sum(F.octet_length("message")).alias("bytes"),
    )
    order = [F.desc("fetched_at"), F.asc("source"), F.asc("event_type")]
    kept = per_type.orderBy(*order).limit(max_types)
    if max_bytes is None:
        return kept
    run = W.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return kept.withColumn("_sum", F.sum("bytes").over(run)).where(F.col("_sum") <= max_bytes).drop("_sum")


def latest_snapshot(
    df: DataFrame, keys: list[str], version: int, now, ttl_days: int = SNAPSHOT_TTL_DAYS, spread: str | None = None
) -> DataFrame:
    """Newest entry per key that is young enough and of the current grading version."""
    young = F.col("analysed_at") > F.lit(now) - F.make_interval(days=F.lit(ttl_days))
    order = [F.desc("analysed_at")] + ([F.asc(spread)] if spread else [])
    return top_n_per_group(df.where(young & (F.col("version") == version)), keys, order, 1, spread=spread)


def sample_stats(samples: DataFrame) -> DataFrame:
    """Event types and events held."""
    per_type = samples.groupBy("source", "event_type").agg(F.count("*").alias("n"))
    return per_type.agg(
        F.count("*").alias("event_types"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("events")
    )
