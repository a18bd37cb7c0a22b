"""The stream gives what the batch gives, each hit once, and reports what it skipped."""

import datetime as dt
import os
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from pactline.functions.conditions import Condition, Watch
from pactline.operators.watch import dedup_hits, grade_hits, hit_digest, match_watches
from pactline.sources.events import parse_events
from pactline.streaming.watch_stream import checkpoint_dir, compact_hits, read_bus, read_hits, start_watch

SCHEMA = "event_id long, ts timestamp, message string"
NOW = dt.datetime(2024, 5, 1, 12, 0)
WATCHES = [
    Watch("big", conditions=(Condition("n", "7"),), label="Sevens"),
    Watch("all", source="svc*"),
    Watch("quiet", event_type="other", notify=False),
]


def messages(spark, ids, minutes):
    rows = [
        (i, NOW - dt.timedelta(minutes=minutes(i)),
         '{"source":"svc-%d","detail-type":"%s","detail":{"n":%d%s}}' % (i % 2, "seen" if i % 3 else "other", i % 10, ',"x":1' if i % 4 == 0 else ""))
        for i in ids
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def contracts(make_contracts):
    return make_contracts(
        {"svc-0@seen": {"Payload": {"type": "object", "properties": {"n": {"type": "integer", "maximum": 7}}}}}
    )


def run(spark, bus, out, contracts, checkpoint=None, files=None, **more):
    checkpoint = checkpoint or checkpoint_dir(spark, f"watch-{uuid.uuid4().hex}", out)
    query = start_watch(read_bus(spark, bus, SCHEMA, files), WATCHES, contracts, out, checkpoint, trigger={"availableNow": True}, **more)
    query.awaitTermination(240)
    assert query.exception() is None
    assert not query.isActive


def test_stream_equals_batch_and_dedups(spark, tmp_path, contracts):
    bus, out = str(tmp_path / "bus"), str(tmp_path / "out")
    first = messages(spark, range(40), lambda i: 59 - i)
    first.coalesce(1).write.parquet(f"{bus}/a")
    run(spark, f"{bus}/*", out, contracts, started_at=NOW - dt.timedelta(minutes=30), max_backlog=None)
    # The same rows again under another name, some new, one that is not an event.
    again = messages(spark, range(20, 45), lambda i: 59 - i).unionByName(
        spark.createDataFrame([(99, NOW, "not json")], SCHEMA)
    )
    again.coalesce(1).write.parquet(f"{bus}/b")
    run(spark, f"{bus}/*", out, contracts, started_at=NOW - dt.timedelta(minutes=30), max_backlog=None)

    got = {(r["watch_id"], r["event_id"], r["grade"], r["backfill"]) for r in spark.read.parquet(f"{out}/hits").collect()}
    assert spark.read.parquet(f"{out}/hits").count() == len(got)
    events, rejected = parse_events(messages(spark, range(45), lambda i: 59 - i).unionByName(again.where("event_id = 99")))
    assert rejected.count() == 1
    hits = dedup_hits(match_watches(events, WATCHES)).withColumn("backfill", F.col("ts") < F.lit(NOW - dt.timedelta(minutes=30)))
    want = {(r["watch_id"], r["event_id"], r["grade"], r["backfill"]) for r in grade_hits(hits, contracts).collect()}
    assert got == want
    grades = {(r[1], r[2]) for r in got}
    # Even ids that are not multiples of three are svc-0@seen.
    assert (8, "failing") in grades and (4, "drifting") in grades and (2, "ok") in grades and (1, "missing") in grades
    said = spark.read.parquet(f"{out}/messages")
    assert said.where("watch_id = 'quiet'").count() == 0
    assert said.where("watch_id = 'all' AND body LIKE '%events matched%'").count() >= 1


def test_backlog_is_bounded_and_reported(spark, tmp_path, contracts):
    bus, out = str(tmp_path / "bus"), str(tmp_path / "out")
    messages(spark, range(10), lambda i: 10 * i).coalesce(1).write.parquet(f"{bus}/a")
    run(spark, f"{bus}/*", out, contracts, now=NOW)
    hits = spark.read.parquet(f"{out}/hits")
    assert hits.agg(F.min("ts")).first()[0] >= NOW - dt.timedelta(hours=1)
    skipped = spark.read.parquet(f"{out}/skipped").first()
    # Minutes 70, 80 and 90: events, not hits.
    assert skipped["events"] == 3 and skipped["to_ts"] < NOW - dt.timedelta(hours=1)


def test_backlog_counts_from_the_start_by_default(spark, tmp_path, contracts):
    bus, out = str(tmp_path / "bus"), str(tmp_path / "out")
    messages(spark, range(5), lambda i: i).coalesce(1).write.parquet(f"{bus}/a")
    run(spark, f"{bus}/*", out, contracts)
    assert spark.read.parquet(f"{out}/hits").count() == 0
    assert spark.read.parquet(f"{out}/skipped").first()["events"] == 5


def test_files_out_of_order_lose_no_hit(spark, tmp_path, contracts):
    bus, out = str(tmp_path / "bus"), str(tmp_path / "out")
    for name, ids in (("a", range(30, 40)), ("b", range(0, 10)), ("c", range(10, 30))):
        messages(spark, ids, lambda i: 59 - i).coalesce(1).write.parquet(f"{bus}/{name}")
        run(spark, f"{bus}/*", out, contracts, max_backlog=None)
    events, _ = parse_events(messages(spark, range(40), lambda i: 59 - i))
    want = {(r["watch_id"], r["event_id"]) for r in match_watches(events, WATCHES).collect()}
    got = [(r["watch_id"], r["event_id"]) for r in spark.read.parquet(f"{out}/hits").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_state_drops_what_comes_again_and_reads_no_stored_hits(spark, tmp_path, contracts):
    """One checkpoint over several runs: deliveries overlap, and the stored hits are gone in between."""
    bus, out, checkpoint = str(tmp_path / "bus"), str(tmp_path / "out"), str(tmp_path / "state")
    got = []
    for name, ids in (("a", range(0, 20)), ("b", range(10, 30)), ("c", range(0, 40))):
        messages(spark, ids, lambda i: 59 - i).coalesce(1).write.parquet(f"{bus}/{name}")
        run(spark, f"{bus}/*", out, contracts, checkpoint, max_backlog=None)
        got += [(r["watch_id"], r["event_id"]) for r in read_hits(spark, out).collect()]
        shutil.rmtree(f"{out}/hits")
    events, _ = parse_events(messages(spark, range(40), lambda i: 59 - i))
    want = {(r["watch_id"], r["event_id"]) for r in match_watches(events, WATCHES).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_compaction_bounds_the_folder_and_loses_no_recent_hit(spark, tmp_path, contracts):
    bus, out, checkpoint = str(tmp_path / "bus"), str(tmp_path / "out"), str(tmp_path / "state")
    assert read_hits(spark, out) is None and compact_hits(spark, out, 15) is None
    for k in range(6):
        messages(spark, range(8 * k, 8 * k + 8), lambda i: 59 - i).coalesce(1).write.parquet(f"{bus}/{k}")
        run(spark, f"{bus}/*", out, contracts, checkpoint, max_backlog=None)
        compact_hits(spark, out, 15)
        folders = len(os.listdir(f"{out}/hits")) + len(os.listdir(f"{out}/hits_kept")) if k else 1
        assert folders <= 3
    events, _ = parse_events(messages(spark, range(48), lambda i: 59 - i))
    want = [(r["ts"], r["event_id"], r["watch_id"]) for r in match_watches(events, WATCHES).collect()]
    want.sort(key=lambda r: (-r[0].timestamp(), r[1], r[2]))
    got = {(r["ts"], r["event_id"], r["watch_id"]) for r in read_hits(spark, out).collect()}
    assert set(want[:15]) <= got <= set(want) and len(got) < 15 + 20
    # A crash between the swap and the clean-up leaves old folders, which nobody counts twice.
    again = read_hits(spark, out).where("batch_id IS NULL").drop("batch_id")
    again.write.parquet(f"{out}/hits/batch_id=0")
    assert {(r["ts"], r["event_id"], r["watch_id"]) for r in read_hits(spark, out).collect()} == got
    compact_hits(spark, out, 15)
    assert "batch_id=0" not in os.listdir(f"{out}/hits")


def test_digest_wording(spark):
    events, _ = parse_events(messages(spark, [7, 17, 27, 37, 1], lambda i: 59 - i))
    hits = match_watches(events, WATCHES)
    rows = {(r["watch_id"], r["pos"]): r for r in hit_digest(hits, WATCHES).collect()}
    assert rows[("big", 1)]["body"] == "4 events matched · latest: svc-1 · seen · n=7"
    assert rows[("big", 1)]["title"] == "Sevens"
    few = hit_digest(hits.where("event_id IN (7, 1)"), WATCHES).where("watch_id = 'all'").orderBy("pos").collect()
    assert [r["body"] for r in few] == ["svc-1 · seen", "svc-1 · seen"]
