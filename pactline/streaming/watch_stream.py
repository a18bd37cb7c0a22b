"""Watches on a live stream: exactly-once hits, graded and announced per micro-batch, and the upkeep of what they write."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pactline.functions.conditions import Watch
from pactline.operators.watch import CATCH_UP, HITS_PER_ENV, dedup_hits, grade_hits, hit_digest, match_watches, retain_hits, rules_of
from pactline.sources.events import parse_events

#: How long a hit's key stays in the stream's state: longer than any repeated delivery takes.
REMEMBER = "2 days"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_bus(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of parsed events from a directory of raw messages."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    events, _ = parse_events(reader.parquet(path))
    return events


def checkpoint_dir(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """Folder for a query's state, below the shared folder the cluster names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not base:
        raise ValueError("set spark.checkpoint.dir, or pass a fallback for a local run")
    return f"{base.rstrip('/')}/{name}"


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _numbered(spark: SparkSession, path: str, prefix: str, whole: bool = False) -> list[int]:
    """Numbers of the folders `<prefix><number>` below a path; `whole` only those whose write has ended."""
    fs, where = _folder(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    found = sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())
    return [k for k in found if not whole or fs.exists(_folder(spark, f"{path}/{prefix}{k}/_SUCCESS")[1])]


def read_hits(spark: SparkSession, out: str) -> DataFrame | None:
    """Stored hits: the newest compacted version, and the batches since; None before the first batch."""
    version = max(_numbered(spark, f"{out}/hits_kept", "upto=", whole=True), default=None)
    newer = [k for k in _numbered(spark, f"{out}/hits", "batch_id=", whole=True) if version is None or k > version]
    parts = [spark.read.option("basePath", f"{out}/hits").parquet(*[f"{out}/hits/batch_id={k}" for k in newer])] if newer else []
    if version is not None:
        parts.insert(0, spark.read.parquet(f"{out}/hits_kept/upto={version}"))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def compact_hits(spark: SparkSession, out: str, n: int = HITS_PER_ENV) -> int | None:
    """Keep the newest `n` stored hits; gives the last batch that was folded in, or None if there was none to fold.

    Runs beside the stream. All batches but the newest, which may be written again after a failure, and the version before
    become one new version. It counts from the moment its write has ended, and only then the folders it replaces go; a reader
    sees the old folders or the new version, never both or neither.
    """
    done = _numbered(spark, f"{out}/hits", "batch_id=", whole=True)[:-1]
    versions = _numbered(spark, f"{out}/hits_kept", "upto=", whole=True)
    done = [k for k in done if not versions or k > versions[-1]]
    if done:
        rows = spark.read.option("basePath", f"{out}/hits").parquet(*[f"{out}/hits/batch_id={k}" for k in done])
        if versions:
            rows = rows.unionByName(spark.read.parquet(f"{out}/hits_kept/upto={versions[-1]}"), allowMissingColumns=True)
        aged = rows.withColumns({"env": F.lit(out), "at": F.col("ts")})
        retain_hits(aged, n).drop("env", "at").write.mode("overwrite").parquet(f"{out}/hits_kept/upto={done[-1]}")
        versions.append(done[-1])
    if not versions:
        return None
    gone = [f"{out}/hits_kept/upto={k}" for k in _numbered(spark, f"{out}/hits_kept", "upto=") if k < versions[-1]]
    gone += [f"{out}/hits/batch_id={k}" for k in _numbered(spark, f"{out}/hits", "batch_id=") if k <= versions[-1]]
    for path in gone:
        fs, where = _folder(spark, path)
        fs.delete(where, True)
    return versions[-1] if done else None


def start_watch(
    events: DataFrame,
    watches: list[Watch],
    contracts: DataFrame,
    out: str,
    checkpoint: str,
    started_at=None,
    max_backlog: str | None = CATCH_UP,
    now=None,
    trigger: dict | None = None,
    remember: str = REMEMBER,
) -> StreamingQuery:
    """Write hits to `out/hits` and messages to `out/messages`.

    A hit that comes again within `remember` of its arrival is dropped by the stream's keyed state, which RocksDB holds and
    which forgets by itself, so a batch costs the same however many hits are stored. Every batch writes one folder per
    batch id, so a replayed batch overwrites itself. The state's clock is the arrival of rows: no event is late, and rows may
    arrive in any order. A query without a checkpoint of its own, over a folder that holds hits, leaves those out too.

    Events older than `max_backlog` before `now` (the start of the query if not given) are skipped and counted in
    `out/skipped`, one by one and not per watch; None skips nothing.
    """
    spark = events.sparkSession
    old = F.lit(False)
    if max_backlog is not None:
        at = now if now is not None else dt.datetime.now(dt.timezone.utc)
        old = F.col("ts") < F.lit(at) - F.expr(f"INTERVAL {max_backlog}")
    rules = rules_of(contracts)  # written once for the life of the stream
    events = events.withColumn("_skipped", F.coalesce(old, F.lit(False)))
    hits = match_watches(events.where("NOT _skipped"), watches)
    if max_backlog is not None:
        hits = hits.unionByName(events.where("_skipped").withColumn("watch_id", F.lit("")))
    hits = hits.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    hits = hits.dropDuplicatesWithinWatermark(["watch_id", "event_id"]).drop("_arrived")
    # A query of its own checkpoint numbers its folders behind those it finds, and keeps that number with the checkpoint.
    own = _numbered(spark, checkpoint, "first=")
    earlier = None if own else read_hits(spark, out)
    if not own:
        own = [1 + max([-1, *_numbered(spark, f"{out}/hits", "batch_id="), *_numbered(spark, f"{out}/hits_kept", "upto=")])]
        fs, where = _folder(spark, f"{checkpoint}/first={own[0]}")
        fs.mkdirs(where)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"batch_id={own[0] + batch_id}"
        # Read by several writes; the stream's source is read once.
        batch = batch.persist()
        try:
            skipped = batch.where("_skipped").agg(F.count("*").alias("events"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))
            skipped.where("events > 0").write.mode("overwrite").parquet(f"{out}/skipped/{folder}")
            fresh = batch.where("NOT _skipped").drop("_skipped")
            if earlier is not None:
                fresh = dedup_hits(fresh, earlier)
            looked_back = F.col("ts") < F.lit(started_at) if started_at is not None else F.lit(False)
            graded = grade_hits(fresh.withColumn("backfill", looked_back), contracts, rules)
            kept = graded.withColumn("message_json", F.to_json("envelope")).drop("envelope", "detail")
            kept.write.mode("overwrite").parquet(f"{out}/hits/{folder}")
            written = spark.read.parquet(f"{out}/hits/{folder}").withColumn("envelope", F.parse_json("message_json"))
            hit_digest(written, watches).write.mode("overwrite").parquet(f"{out}/messages/{folder}")
        finally:
            batch.unpersist()

    writer = hits.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS_DB)  # a query takes its settings along when it starts
    try:
        return writer.trigger(**(trigger or {"processingTime": "15 seconds"})).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
