"""What the operators share: the shared scratch folder, written tables, bounded text chunks, row hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def tune(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Arrow batches of 1,000 rows: with whole texts in them a Python worker stays in the tens of MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in `spark.checkpoint.dir`.

    Only a local master, as in tests, gets a folder of its own where that setting is missing; a cluster without it is
    refused, since a folder of one machine can't be read by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="pactline-llm-")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/pactline-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and go on from there: computed once, and safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later step reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_part(key: str | Column, parts: int) -> Column:
    """crc32 of a key as text, modulo `parts`; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % F.lit(parts)


def chunks(texts: Sequence[str | None], max_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `max_chars` together; a longer text stands alone."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text is not None else 0
        if i > start and held + size > max_chars:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
