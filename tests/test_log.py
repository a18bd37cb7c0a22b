"""Searches of a log of days."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from pactline.plans.check import events_for_issue
from pactline.sources import events as ev

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
DAYS = 20
END = START + dt.timedelta(days=DAYS)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Twenty days of events, one every ten minutes; of the first twelve days no file can be read."""
    path = str(tmp_path_factory.mktemp("log") / "events")
    n = DAYS * 144
    at = F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("id") * 600)
    detail = F.concat(F.lit('{"k":'), F.when(F.col("id") % 100 == 0, '"odd"').otherwise(F.col("id").cast("string")), F.lit("}"))
    rows = spark.range(n).select(F.col("id").alias("event_id"), at.alias("ts"), F.lit("a").alias("source"), F.lit("t").alias("event_type"), F.parse_json(detail).alias("detail"))
    ev.write_log(rows, path)
    for day in range(12):
        for file in glob.glob(f"{path}/day={(START + dt.timedelta(days=day)).date()}/*.parquet"):
            with open(file, "wb") as f:
                f.write(b"broken")
    kinds = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in rows.schema)
    return spark.read.schema(f"{kinds}, day date").parquet(path), n


def test_reads_no_further_than_the_page_needs(log):
    events, n = log
    page = ev.search_events(events, F.lit(True), 50, start=START, end=END).collect()
    assert sorted(r["event_id"] for r in page) == list(range(n - 50, n))
    assert {r["complete"] for r in page} == {False} and {r["searched_from"] for r in page} == {min(r["ts"] for r in page)}
    last = min(page, key=lambda r: r["ts"])
    more = ev.search_events(events, F.lit(True), 50, before=(last["ts"], last["event_id"]), start=START, end=END).collect()
    assert sorted(r["event_id"] for r in more) == list(range(n - 100, n - 50))


def test_runs_of_slices_double_and_stop(log):
    events, n = log
    steps = []
    found = ev.newest_first(events, lambda d: d.where("event_id % 100 = 0"), 7, START, END, reached=lambda since, k: steps.append((since, k)))
    assert sorted(r["event_id"] for r in found.collect()) == list(range(n - 80 - 6 * 100, n - 79, 100))
    hours = [round((a - b).total_seconds() / 3600) for a, b in zip([END, *[s for s, _ in steps]], [s for s, _ in steps])]
    assert hours == [24, 48, 96] and sum(k for _, k in steps) == 8


def test_slices_are_those_of_the_table(spark):
    w = spark.createDataFrame([(int(START.timestamp() * 1000), int(END.timestamp() * 1000))], "start_ms long, end_ms long")
    cuts = {r["from_ms"] for r in ev.time_slices(w).collect()}
    steps = list(ev.steps_back(START, END))
    assert {int(a.timestamp() * 1000) for a, _ in steps} <= cuts and steps[0][1] == END and steps[-1][0] == START
    assert all(a == b for (a, _), (_, b) in zip(steps, steps[1:]))


def test_both_forms_agree(log):
    events, _ = log
    since = START + dt.timedelta(days=13)
    for limit in (1, 9, 10, 500):
        for preds in (F.lit(True), F.col("event_id") % 100 == 0, F.lit(False)):
            staged = ev.search_events(events, preds, limit, start=since, end=END)
            once = ev.search_events(ev.within(events, since, END), preds, limit)
            columns = ["event_id", "ts", "complete", "searched_from"]
            assert sorted(map(tuple, staged.select(*columns).collect())) == sorted(map(tuple, once.select(*columns).collect()))


def test_events_of_an_issue_read_the_newest_days(log, make_contracts):
    events, n = log
    contracts = make_contracts({"a@t": {"Payload": {"type": "object", "properties": {"k": {"type": "integer"}}}}})
    recent = ev.within(events, START + dt.timedelta(days=12), END)  # the names are counted over readable days
    found = events_for_issue(recent, contracts, "a@t", "wrongType:k", 4, start=START, end=END)
    assert sorted(r["event_id"] for r in found.collect()) == [n - 80 - 300, n - 80 - 200, n - 80 - 100, n - 80]
