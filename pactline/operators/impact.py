"""Severity graded by who reads a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("[]"), F.lit("")), r"\."), lambda s: s != "")


def _prefixes(segments: Column) -> Column:
    lengths = F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments)))
    return F.transform(lengths, lambda i: F.array_join(F.slice(segments, F.lit(1), i), "."))


def reader_relations(iss: DataFrame, reads: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """`(path, file, reads)` for every file touching an issue's field.

    A read of the field or inside it is a reader; a read of an ancestor passes the field along. Both
    relations are equi joins: one side lists the prefixes of its path, the other joins on them.
    """
    keys = list(keys)
    about = iss.where((F.col("path") != "") & ~F.col("kind").isin("unregistered", "concern"))
    paths = about.select(*keys, "path").distinct().withColumn("_seg", _segments(F.col("path")))
    paths = paths.withColumn("_norm", F.array_join("_seg", "."))
    read = _reads(reads, keys)
    inside = (
        read.select(*keys, "file", F.explode(_prefixes(F.col("_rseg"))).alias("_norm"))
        .join(paths.select(*keys, "path", "_norm"), [*keys, "_norm"])
        .select(*keys, "path", "file", F.lit(True).alias("reads"))
    )
    above = (
        paths.select(*keys, "path", "_norm", F.explode(_prefixes(F.col("_seg"))).alias("_read"))
        .where("_read <> _norm")
        .join(read.select(*keys, "file", "_read"), [*keys, "_read"])
        .select(*keys, "path", "file", F.lit(False).alias("reads"))
    )
    return inside.unionByName(above).groupBy(*keys, "path", "file").agg(F.max("reads").alias("reads"))


def _reads(reads: DataFrame, keys: list[str]) -> DataFrame:
    rows = reads.select(*keys, "file", _segments(F.col("path")).alias("_rseg")).where(F.size("_rseg") > 0)
    return rows.withColumn("_read", F.array_join("_rseg", "."))


def grade_by_readers(iss: DataFrame, reads: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Add the counts `handlers, readers, indirect` and re-grade `severity` by them.

    `reads` has `file, path` per key. Without any handler the severity keeps its floor; who the
    readers are is in `reader_relations`.
    """
    keys = list(keys)
    who = reader_relations(iss, reads, tuple(keys)).groupBy(*keys, "path").agg(
        F.count_if("reads").alias("readers"), F.count_if(~F.col("reads")).alias("indirect")
    )
    handlers = _reads(reads, keys).groupBy(*keys).agg(F.countDistinct("file").alias("handlers"))
    base = iss.drop("handlers", "readers", "indirect")
    graded = base.join(handlers, keys, "left").join(who, [*keys, "path"], "left")
    field = (F.col("path") != "") & ~F.col("kind").isin("unregistered", "concern") & F.col("handlers").isNotNull()
    floor = F.when(F.col("rejects"), "error").when(F.col("kind") == "neverSeen", "info").otherwise("warning")
    readers, indirect = F.coalesce("readers", F.lit(0)), F.coalesce("indirect", F.lit(0))
    moved = (
        F.when(~field, floor)
        .when(readers > 0, F.when(floor == "info", "warning").otherwise("error"))
        .when(indirect == 0, F.when(floor == "error", "warning").otherwise("info"))
        .otherwise(floor)
    )
    return graded.withColumns(
        {
            "severity": moved,
            "readers": F.when(field, readers),
            "indirect": F.when(field, indirect),
            "handlers": F.when(field, F.col("handlers")),
        }
    )
