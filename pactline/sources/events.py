"""Event tables: envelope parsing, windowed scans, search and channel inventory."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.functions.names import event_key, sanitize_name
from pactline.session import cut

# Slice bounds of the look-back search and the marker of redacted channels.
SLICE_MIN_MS = 5 * 60 * 1000
SLICE_MAX_MS = 6 * 60 * 60 * 1000
SLICES_PER_WINDOW = 16
# Fixed value: slices that a search reads first; each later step reads twice as many as the one before.
SLICES_AT_ONCE = 4
REDACTED_MARK = "external-events"


def parse_events(df: DataFrame, message_col: str = "message") -> tuple[DataFrame, DataFrame]:
    """Split raw messages into events and the rows that are not events.

    Keeps every input column; adds `envelope`, `source`, `event_type`, `detail`. Works on streams.
    The test sits in a generator, not in a filter: a filter would be pushed below the projection and
    parse every message once per condition.
    """
    env = F.col("envelope")
    parsed = df.withColumn("envelope", F.try_parse_json(message_col))
    row = F.struct(
        _string_member(env, '$["source"]').alias("source"),
        _string_member(env, '$["detail-type"]').alias("event_type"),
        F.try_variant_get(env, "$.detail", "variant").alias("detail"),
    )
    good = F.filter(
        F.array(row), lambda r: r["source"].isNotNull() & r["event_type"].isNotNull() & r["detail"].isNotNull()
    )
    events = parsed.select("*", F.inline(good))
    rejected = parsed.select(*df.columns, F.explode(F.when(F.size(good) == 0, F.array(F.lit(0)))).alias("_")).drop("_")
    return events, rejected


def _string_member(env: Column, path: str) -> Column:
    value = F.try_variant_get(env, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(env, path, "string"))


def scan_events(
    df: DataFrame,
    start=None,
    end=None,
    source: str | None = None,
    event_type: str | None = None,
    around=None,
    now=None,
) -> DataFrame:
    """Events of one identity in `[start, end)`, or one minute each side of `around`.

    Only plain comparisons on columns, so they reach the scan as pushed filters.
    """
    cond = F.lit(True)
    if around is not None:
        at = F.lit(around)
        upper = at + F.expr("INTERVAL 1 MINUTE")
        upper = upper if now is None else F.least(upper, F.lit(now))
        cond = cond & F.col("ts").between(at - F.expr("INTERVAL 1 MINUTE"), upper)
    if start is not None:
        cond = cond & (F.col("ts") >= F.lit(start))
    if end is not None:
        cond = cond & (F.col("ts") < F.lit(end))
    if source is not None:
        cond = cond & (F.col("source") == source)
    if event_type is not None:
        cond = cond & (F.col("event_type") == event_type)
    return df.where(cond)


def write_log(events: DataFrame, path: str) -> None:
    """Write events as a log: a folder a day, and files that each hold one stretch of time.

    The rows are dealt by ranges of their time, so a busy day is many files and a file's statistics exclude it from the
    slices that it has no part in.
    """
    rows = events.withColumn("day", F.to_date("ts")).repartitionByRange("day", "ts")
    rows.sortWithinPartitions("day", "ts").write.partitionBy("day").parquet(path)


def within(df: DataFrame, start, end) -> DataFrame:
    """Rows of `[start, end)`; a table with a column `day`, as `write_log` has it, is pruned to the days of the window."""
    rows = df.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    if "day" in df.columns:
        rows = rows.where((F.col("day") >= F.to_date(F.lit(start))) & (F.col("day") <= F.to_date(F.lit(end))))
    return rows


def search_events(
    df: DataFrame, preds: Column, limit: int, before: tuple | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> DataFrame:
    """Newest `limit` matches; `before=(ts, event_id)` continues an older page.

    `complete` says whether the search reached the end of the data, `searched_from` how far back it
    looked: the oldest returned time when cut, else NULL. The page is a top-k, so it stays small.

    With a window `[start, end)` the log is read newest first, a few slices at a time, and no further than the page needs;
    without, in one pass.
    """

    def find(rows: DataFrame) -> DataFrame:
        hits = rows.where(preds)
        if before is not None:
            ts, event_id = F.lit(before[0]), F.lit(before[1])
            hits = hits.where((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("event_id") > event_id)))
        return hits

    if start is None or end is None:
        return _paged(find(df).orderBy(*_newest()).limit(limit + 1), df.columns, limit)
    if before is not None:
        edge = before[0].astimezone(end.tzinfo) if end.tzinfo else before[0]
        end = max(start, min(end, edge + dt.timedelta(milliseconds=1)))
    return newest_first(df, find, limit, start, end)


def _newest() -> list[Column]:
    return [F.desc("ts"), F.asc("event_id")]


def _paged(page: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """The first `limit` of at most `limit + 1` rows, with `complete` and `searched_from`."""
    # One window over at most limit + 1 rows.
    everything, newest = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(*_newest())
    kept = page.withColumns({"_n": F.count("*").over(everything), "_rn": F.row_number().over(newest)}).where(
        F.col("_rn") <= limit
    )
    cut_short = F.col("_n") > limit
    return kept.select(
        *columns, (~cut_short).alias("complete"), F.when(cut_short, F.min("ts").over(everything)).alias("searched_from")
    )


def steps_back(start: dt.datetime, end: dt.datetime) -> Iterator[tuple[dt.datetime, dt.datetime]]:
    """The window's slices, as `time_slices` cuts them, in runs from the newest back: four, then eight, and so on."""
    window = max((end - start) // dt.timedelta(milliseconds=1), 1)
    width = dt.timedelta(milliseconds=max(min(window // SLICES_PER_WINDOW, SLICE_MAX_MS), SLICE_MIN_MS))
    at_once, to = SLICES_AT_ONCE, end
    while to > start:
        since = max(to - at_once * width, start)
        yield since, to
        at_once, to = 2 * at_once, since


def newest_first(
    df: DataFrame, find: Callable[[DataFrame], DataFrame], limit: int, start: dt.datetime, end: dt.datetime,
    reached: Callable[[dt.datetime, int], None] | None = None, columns: list[str] | None = None,
) -> DataFrame:
    """The newest `limit` rows that `find` keeps of the events of `[start, end)`, as one pass over all of it would give.

    A loop on the driver over runs of slices: each is a pruned scan whose page is written, and the loop ends when the page
    is full. Runs double, so a search that meets nothing takes a logarithm of the slices, and none reads much over twice
    of what it needs. `reached` is told how far back each step has read and what it found.
    """
    pages, missing = [], limit + 1
    for since, to in steps_back(start, end):
        page = cut(find(within(df, since, to)).orderBy(*_newest()).limit(missing))
        found = page.count()
        if found or not pages:
            pages.append(page)
        missing -= found
        if reached is not None:
            reached(since, found)
        if not missing:
            break
    if not pages:
        pages = [find(df).limit(0)]
    whole = pages[0]
    for page in pages[1:]:
        whole = whole.unionByName(page)
    return _paged(whole, columns or df.columns, limit)


def slice_width_ms(start_ms: Column, end_ms: Column) -> Column:
    """Width of one look-back slice."""
    window = F.greatest(end_ms - start_ms, F.lit(1))
    width = F.floor(window / SLICES_PER_WINDOW).cast("bigint")
    return F.greatest(F.least(width, F.lit(SLICE_MAX_MS)), F.lit(SLICE_MIN_MS)).cast("bigint")


def time_slices(windows: DataFrame) -> DataFrame:
    """Cut each row's `[start_ms, end_ms)` into slices, newest first.

    Adds `slice` (0 = newest), `from_ms`, `to_ms`.
    """
    w = windows.withColumn("_width", slice_width_ms(F.col("start_ms"), F.col("end_ms")))
    count = F.ceil((F.col("end_ms") - F.col("start_ms")) / F.col("_width")).cast("bigint")
    idx = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))
    return (
        w.select("*", F.explode(idx).alias("slice"))
        .withColumn("to_ms", F.col("end_ms") - F.col("slice") * F.col("_width"))
        .withColumn("from_ms", F.greatest(F.col("to_ms") - F.col("_width"), F.col("start_ms")))
        .drop("_width")
    )


def slice_counts(df: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Events per slice; the slice number is arithmetic, so no join is needed."""
    width = slice_width_ms(F.lit(start_ms), F.lit(end_ms))
    ms = F.unix_millis(F.col("ts"))
    inside = df.where((ms >= start_ms) & (ms < end_ms))
    number = F.floor((F.lit(end_ms) - 1 - ms) / width).cast("bigint")
    return inside.groupBy(number.alias("slice")).agg(F.count("*").alias("events"))


def is_redacted(channel: Column) -> Column:
    """Channels that carry redacted copies."""
    return channel.contains(REDACTED_MARK)


def channel_counts(df: DataFrame, redacted: Column | None = None) -> DataFrame:
    """Volume per event type, `full` and `redacted` copies apart: one row per type."""
    redacted = is_redacted(F.col("channel")) if redacted is None else redacted
    return df.groupBy("source", "event_type").agg(
        F.count_if(redacted).alias("redacted"), F.count_if(~redacted).alias("full")
    )


def split_channels(df: DataFrame, redacted: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Full copies for grading, and the keys seen only as redacted copies with their counts."""
    redacted = is_redacted(F.col("channel")) if redacted is None else redacted
    only = channel_counts(df, redacted).where("full = 0").select("source", "event_type", F.col("redacted").alias("seen"))
    return df.where(~redacted), only


def channel_inventory(configured: DataFrame, seen: DataFrame) -> DataFrame:
    """Configured and discovered channels in one list, configured first, absent ones kept."""
    found = seen.groupBy("channel").agg(F.count("*").alias("events"))
    conf = configured.select("channel").distinct().withColumn("_conf", F.lit(True))
    return (
        conf.join(found, "channel", "full_outer")
        .select(
            "channel",
            F.coalesce("_conf", F.lit(False)).alias("configured"),
            F.col("events").isNotNull().alias("present"),
            F.coalesce("events", F.lit(0).cast("bigint")).alias("events"),
        )
        .orderBy(F.desc("configured"), "channel")
    )


def event_sources(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """Every known producer, the spelling a rule must match, and whether traffic shows it."""
    live = events.groupBy("source").agg(F.lit(True).alias("in_traffic"))
    live = (
        live.withColumn("pattern", sanitize_name(F.col("source")))
        .groupBy("pattern")
        .agg(F.max("source").alias("live_source"), F.max("in_traffic").alias("in_traffic"))
    )
    registered = (
        contracts.select("source")
        .distinct()
        .withColumn("pattern", sanitize_name(F.col("source")))
        .groupBy("pattern")
        .agg(F.min("source").alias("registered"))
    )
    return (
        live.join(registered, "pattern", "full_outer")
        .select(
            F.coalesce("live_source", "registered").alias("source"),
            "pattern",
            F.coalesce("in_traffic", F.lit(False)).alias("in_traffic"),
        )
        .orderBy("pattern")
    )


def traffic_keys(events: DataFrame) -> DataFrame:
    """Event types on the bus with their volume: one row each, contract-sized."""
    return events.groupBy("source", "event_type").agg(F.count("*").alias("observed")).withColumn(
        "event_key", event_key(F.col("source"), F.col("event_type"))
    )
