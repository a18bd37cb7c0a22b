"""Buses declared in configuration against buses that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topology_drift(declared: DataFrame, live: DataFrame, stage: str) -> DataFrame:
    """`side` = `declared_only` or `live_only` per bus; the stage's own buses and `default` are not drift."""
    wanted = declared.where(F.col("stage") == stage)
    missing = wanted.join(live, "bus", "left_anti").select(F.lit("declared_only").alias("side"), "bus")
    extra = live.join(wanted, "bus", "left_anti").where(
        ~F.col("bus").startswith(f"{stage}-") & (F.col("bus") != "default")
    )
    return missing.unionByName(extra.select(F.lit("live_only").alias("side"), "bus"))


def arn_part(arn, i: int):
    """The i-th segment of an ARN, NULL when empty."""
    text = F.get(F.split(arn, ":"), i)
    return F.when(text != "", text)


def topology_targets(live: DataFrame) -> DataFrame:
    """One row per target; buses without rules and rules without targets stay.

    `live` has `bus, arn, rules array<struct<name, state, pattern, targets array<struct<id, arn>>>>`.
    """
    rules = live.select("bus", "arn", F.explode_outer("rules").alias("r"))
    targets = rules.select("bus", "arn", "r.name", "r.state", F.explode_outer("r.targets").alias("t"))
    return targets.select(
        "bus",
        arn_part("arn", 3).alias("region"),
        arn_part("arn", 4).alias("account"),
        F.col("name").alias("rule"),
        "state",
        F.col("t.id").alias("target"),
        arn_part("t.arn", 2).alias("service"),
    )
