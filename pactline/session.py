"""Session settings and the size check every broadcast in the library goes through."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 256 * 1024 * 1024

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffles start in many small parts, whatever the session's number, and small ones are put together again: what one
    # task holds does not grow with the table until parts are large.
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "384",
    # JSON objects with a repeated member keep the last one instead of failing to parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Example-carrying aggregates keep string buffers; hash them instead of sorting the input.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators are tuned for; cluster sizing stays with the cluster."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def broadcast_checked(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring the table; a larger one keeps Spark's own join choice.

    Runs one aggregate over the (contract-sized) table. Streaming frames are never hinted.
    """
    if df.isStreaming:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= max_bytes else df


_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`.

    A session of one process that lacks the setting, as in tests, gets one temporary folder, deleted when Python ends; a
    cluster without it is refused, so that the same call never does the work in two ways.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="pactline-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId], ignore_errors=True)
    return _OWN[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write a contract-sized result once and go on from the written table.

    What several later steps read is then computed once, survives the loss of executors, and has a
    known size, so Spark chooses its joins by it.
    """
    if df.isStreaming:
        return df
    path = f"{scratch_dir(df.sparkSession)}/pactline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
