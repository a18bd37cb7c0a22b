"""Registered queries over the bus: scans, samples, profiles, drift, violations, issues, health."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from pactline.functions.json_types import json_text
from pactline.operators import contracts as ct
from pactline.operators import drift as d
from pactline.operators import impact, infer, repairs, samples, shape
from pactline.operators import issues as iss
from pactline.operators import observe as ob
from pactline.operators import violations as vi
from pactline.plans import check as ck
from pactline.plans import health as he
from pactline.session import cut, scratch_dir
from pactline.sources import events as ev
from pactline.sources.contracts_io import parse_contracts
from workload import bus as w
from workload.oracle import sql

T0 = dt.datetime(2024, 1, 1)
START_MS = 1704067200000
DAY = 86400000
END_MS = START_MS + 30 * DAY

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def ms(col="ts"):
    return F.unix_millis(F.col(col))


def at(offset_ms: int):
    return F.timestamp_millis(F.lit(START_MS + offset_ms))


def bus(spark, sf):
    return w.bus(spark, sf)


def run(spark, sf) -> ck.Check:
    return ck.Check(w.bus(spark, sf), w.bus_contracts(spark))


# --- scans and samples --------------------------------------------------------------------------

_BROKEN = (
    "CASE WHEN event_id % 97 = 0 THEN left(message, 20) WHEN event_id % 89 = 0 THEN replace(message, '\"detail-type\"', '\"kind\"')"
    " ELSE message END"
)


@query(
    "envelope_parse",
    sql("bus", """SELECT src AS source, t AS event_type, CAST(0 AS BIGINT) AS rejected, count(*) AS events FROM bus WHERE e % 97 <> 0 AND e % 89 <> 0 GROUP BY ALL
    UNION ALL SELECT NULL, NULL, 1, count(*) FROM bus WHERE e % 97 = 0 OR e % 89 = 0"""),
)
def envelope_parse(spark, sf):
    raw = w.raw_messages(spark, sf).where("channel = '/bus/main'").withColumn("message", F.expr(_BROKEN))
    good, bad = ev.parse_events(raw)
    counted = good.groupBy("source", "event_type").agg(F.lit(0).cast("bigint").alias("rejected"), F.count("*").alias("events"))
    rest = bad.agg(F.count("*").alias("events")).select(
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("event_type"),
        F.lit(1).cast("bigint").alias("rejected"), "events",
    )
    return counted.unionByName(rest)


@query(
    "event_scan",
    sql("bus", f"SELECT e AS event_id, ms AS at FROM bus WHERE ms >= {START_MS + 2 * DAY} AND ms < {START_MS + 9 * DAY} AND src = 'billing-invoices' AND t = 'purchase'"),
)
def event_scan(spark, sf):
    hits = ev.scan_events(bus(spark, sf), at(2 * DAY), at(9 * DAY), "billing-invoices", "purchase")
    return hits.select("event_id", ms().alias("at"))


@query(
    "event_scan_around",
    sql("bus", """SELECT e AS event_id, ms AS at FROM bus, (SELECT arg_min(ms, e) AS mid FROM bus) WHERE ms BETWEEN mid - 60000 AND mid + 20000
    UNION ALL SELECT e, ms FROM bus, (SELECT arg_max(ms, e) AS mid FROM bus) WHERE ms BETWEEN mid - 60000 AND mid + 60000"""),
)
def event_scan_around(spark, sf):
    """A minute each side of the first and the last event; of the first, up to a `now` 20 seconds later."""
    events = bus(spark, sf).select("event_id", "ts")
    mid = events.agg(F.min_by(ms(), "event_id").alias("first"), F.max_by(ms(), "event_id").alias("last")).first()
    first, last = mid["first"] - START_MS, mid["last"] - START_MS
    around = ev.scan_events(events, around=at(first), now=at(first + 20_000))
    return around.unionByName(ev.scan_events(events, around=at(last))).select("event_id", ms().alias("at"))


_TOPN = """hits AS (SELECT e, ts, ms FROM bus WHERE src = 'harbour-desk' AND status = 'held' {more}),
page AS (SELECT * FROM hits ORDER BY ts DESC, e LIMIT 20)"""
_TOPN_BODY = """SELECT e AS event_id, ms AS at, (SELECT count(*) FROM hits) <= 20 AS complete,
CASE WHEN (SELECT count(*) FROM hits) > 20 THEN (SELECT min(ms) FROM page) END AS searched_from FROM page"""


def _retry():
    return (F.col("source") == "harbour-desk") & (F.try_variant_get("detail", "$.status", "string") == "held")


@query("event_search", sql("bus", _TOPN_BODY, _TOPN.format(more="")))
def event_search(spark, sf):
    page = ev.search_events(bus(spark, sf), _retry(), 20)
    return page.select("event_id", ms().alias("at"), "complete", ms("searched_from").alias("searched_from"))


@query(
    "event_search_continue",
    sql("bus", """SELECT event_id, m AS at, complete, min(m) FILTER (NOT complete) OVER () AS searched_from FROM (
      SELECT e AS event_id, ms AS m, rn, (SELECT count(*) FROM hits) <= 40 AS complete FROM hits WHERE rn BETWEEN 21 AND 40)""",
        "hits AS (SELECT e, ms, row_number() OVER (ORDER BY ts DESC, e) AS rn FROM bus WHERE src = 'harbour-desk' AND status = 'held')"),
)
def event_search_continue(spark, sf):
    events = bus(spark, sf)
    last = ev.search_events(events, _retry(), 20).orderBy("ts", F.desc("event_id")).first()
    page = ev.search_events(events, _retry(), 20, before=(last["ts"], last["event_id"]))
    return page.select("event_id", ms().alias("at"), "complete", ms("searched_from").alias("searched_from"))


def _log(spark, sf):
    """The bus as a log of days."""
    path = f"{scratch_dir(spark)}/pactline/{uuid.uuid4().hex}"
    ev.write_log(bus(spark, sf), path)
    return spark.read.parquet(path)


_WINDOW = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)


@query("event_search_newest", sql("bus", _TOPN_BODY, _TOPN.format(more=f"AND ms >= {START_MS} AND ms < {END_MS}")))
def event_search_newest(spark, sf):
    page = ev.search_events(_log(spark, sf), _retry(), 20, start=_WINDOW[0], end=_WINDOW[1])
    return page.select("event_id", ms().alias("at"), "complete", ms("searched_from").alias("searched_from"))


@query(
    "event_search_sparse",
    sql("bus", f"SELECT e AS event_id, TRUE AS complete FROM bus WHERE ms >= {START_MS} AND ms < {END_MS} AND t = 'signup' AND amount = 'string' AND src = 'billing-invoices'"),
)
def event_search_sparse(spark, sf):
    """Matches that fill no page: the search reaches the start of the window."""
    wanted = (F.col("source") == "billing-invoices") & (F.col("event_type") == "signup")
    wanted &= F.schema_of_variant(F.try_variant_get("detail", "$.amount", "variant")) == "STRING"
    page = ev.search_events(_log(spark, sf), wanted, 10_000, start=_WINDOW[0], end=_WINDOW[1])
    return page.select("event_id", "complete")


_WIN = """w AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS s, epoch_ms(o_orderdate) + (o_orderkey % 400) * 3600000 AS f FROM orders)"""


def _windows(spark, sf):
    return w.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("start_ms"),
        (F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 400) * 3600000).alias("end_ms"),
    )


@query(
    "time_slices",
    "WITH " + _WIN + """, v AS (SELECT *, greatest(least(greatest(f - s, 1) // 16, 21600000), 300000) AS width FROM w)
    SELECT id, CAST(ceil((f - s) / width) AS BIGINT) AS slices, f - s - (CAST(ceil((f - s) / width) AS BIGINT) - 1) * width AS last_width FROM v WHERE f > s""",
)
def time_slices(spark, sf):
    cut = ev.time_slices(_windows(spark, sf))
    return cut.groupBy("id").agg(
        F.count("*").alias("slices"),
        F.max_by(F.col("to_ms") - F.col("from_ms"), "slice").alias("last_width"),
    )


@query(
    "slice_counts",
    sql("bus", f"SELECT ({END_MS} - 1 - ms) // 21600000 AS slice, count(*) AS events FROM bus WHERE ms >= {START_MS} AND ms < {END_MS} GROUP BY ALL"),
)
def slice_counts(spark, sf):
    return ev.slice_counts(bus(spark, sf), START_MS, END_MS)


@query(
    "channel_split",
    """WITH b AS (SELECT CASE user_id % 4 WHEN 0 THEN 'harbour-desk' WHEN 1 THEN 'billing-invoices' WHEN 2 THEN 'billing-ledger' ELSE 'Tide Tables' END AS source,
    event_type, user_id % 4 = 2 AND event_type = 'signup' AS ext FROM events)
    SELECT source, event_type, count(*) AS seen FROM b WHERE ext GROUP BY ALL""",
)
def channel_split(spark, sf):
    return ev.split_channels(w.all_channels(spark, sf))[1]


@query(
    "channel_inventory",
    sql("bus", """SELECT '/bus/main' AS channel, TRUE AS configured, TRUE AS present, (SELECT count(*) FROM bus) AS events
    UNION ALL SELECT '/bus/external-events', FALSE, TRUE, (SELECT count(*) FROM b WHERE ext OR e % 10 = 0)
    UNION ALL SELECT '/bus/typo', TRUE, FALSE, 0"""),
)
def channel_inventory(spark, sf):
    conf = spark.createDataFrame([("/bus/main",), ("/bus/typo",)], "channel string")
    return ev.channel_inventory(conf, w.raw_messages(spark, sf).select("channel"))


@query(
    "event_sources",
    sql("bus", """SELECT DISTINCT src AS source, replace(src, ' ', '-') AS pattern, TRUE AS in_traffic FROM bus
    UNION ALL SELECT 'orders-api', 'orders-api', FALSE"""),
)
def event_sources(spark, sf):
    return ev.event_sources(bus(spark, sf), w.bus_contracts(spark))


_STRIPE = f"""striped AS (SELECT *, least((ms - {START_MS}) // {(END_MS - START_MS) // 8}, 7) AS stripe FROM bus WHERE ms >= {START_MS} AND ms < {END_MS})"""


@query(
    "stripe_ranges",
    "WITH " + _WIN + """ SELECT id, CASE WHEN f > s THEN least(8, f - s) ELSE 1 END AS stripes, f - s - 7 * ((f - s) // 8) AS last_width FROM w WHERE f > s""",
)
def stripe_ranges(spark, sf):
    cut = samples.stripe_ranges(_windows(spark, sf).where("end_ms > start_ms"))
    return cut.groupBy("id").agg(
        F.count("*").alias("stripes"), F.max_by(F.col("to_ms") - F.col("from_ms"), "stripe").alias("last_width")
    )


@query(
    "striped_sample",
    sql("bus", "SELECT e AS event_id, CAST(stripe AS INTEGER) AS stripe FROM (SELECT *, row_number() OVER (PARTITION BY stripe ORDER BY ts, e) AS rn FROM striped) WHERE rn <= 63 ORDER BY ts DESC, event_id LIMIT 500", _STRIPE),
)
def striped_sample(spark, sf):
    return samples.striped_sample(bus(spark, sf), START_MS, END_MS, 500).select("event_id", "stripe")


@query(
    "sample_coverage",
    sql("bus", """SELECT count(*) AS events, count(DISTINCT src || '@' || t) AS event_types, (max(ms) - min(ms)) // 60000 AS minutes_covered,
    (SELECT max(n) > 63 FROM (SELECT count(*) AS n FROM striped GROUP BY stripe)) AS truncated FROM striped""", _STRIPE),
)
def sample_coverage(spark, sf):
    return samples.sample_coverage(bus(spark, sf), START_MS, END_MS, 500)


@query(
    "cap_per_type",
    sql("bus", """SELECT src AS source, t AS event_type, e AS event_id, observed FROM (SELECT *, count(*) OVER (PARTITION BY src, t) AS observed,
    row_number() OVER (PARTITION BY src, t ORDER BY ts DESC, e) AS rn FROM bus) WHERE rn <= 50"""),
)
def cap_per_type(spark, sf):
    return samples.cap_per_type(bus(spark, sf)).select("source", "event_type", "event_id", "observed")


@query(
    "merge_sample",
    sql("bus", """SELECT src AS source, t AS event_type, e AS event_id, CAST(CASE WHEN e % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS origin
    FROM (SELECT *, row_number() OVER (PARTITION BY src, t ORDER BY ts DESC, e) AS rn FROM bus WHERE e % 3 = 0 OR e % 2 = 0) WHERE rn <= 200"""),
)
def merge_sample(spark, sf):
    events = bus(spark, sf).select("channel", "source", "event_type", "event_id", "ts")
    old = events.where("event_id % 3 = 0").withColumn("origin", F.lit(0))
    new = events.where("event_id % 2 = 0").withColumn("origin", F.lit(1))
    return samples.merge_sample(old, new).select("source", "event_type", "event_id", "origin")


_FETCH = """f AS (SELECT o_custkey AS key, epoch_ms(o_orderdate) AS s, epoch_ms(o_orderdate) + (o_orderkey % 90) * 86400000 AS e FROM orders WHERE o_orderstatus <> 'P'),
m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS n FROM f),
i AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
cov AS (SELECT key, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY key, island)"""


def _coverage(spark, sf):
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    fetches = w.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), start.alias("start_ms"),
        (start + (F.col("o_orderkey") % 90) * DAY).alias("end_ms"), (F.col("o_orderstatus") == "P").alias("truncated"),
    )
    return samples.coverage(fetches, ["key"])


@query("coverage_islands", f"WITH {_FETCH} SELECT key, start_ms, end_ms FROM cov")
def coverage_islands(spark, sf):
    return _coverage(spark, sf)


@query(
    "coverage_check",
    f"""WITH {_FETCH}, q AS (SELECT o_orderkey AS window_id, o_custkey AS key, epoch_ms(o_orderdate) + 86400000 AS a, epoch_ms(o_orderdate) + 11 * 86400000 AS z FROM orders)
    SELECT window_id, EXISTS (SELECT 1 FROM cov WHERE cov.key = q.key AND cov.start_ms <= q.a AND cov.end_ms >= q.z) AS covered FROM q""",
)
def coverage_check(spark, sf):
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    asked = w.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("window_id"), F.col("o_custkey").alias("key"),
        (start + DAY).alias("from_ms"), (start + 11 * DAY).alias("to_ms"),
    )
    return samples.is_covered(_coverage(spark, sf), asked, ["key"]).select("window_id", "covered")


@query(
    "sample_retention",
    """WITH s AS (SELECT source, lang AS event_type, max(doc_id) AS fetched_at, count(*) AS events, sum(strlen(text)) AS bytes FROM documents GROUP BY ALL),
    k AS (SELECT * FROM s ORDER BY fetched_at DESC, source, event_type LIMIT 60)
    SELECT source, event_type, fetched_at, events, CAST(bytes AS BIGINT) AS bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY fetched_at DESC, source, event_type ROWS UNBOUNDED PRECEDING) AS r FROM k) WHERE r <= 2000000""",
)
def sample_retention(spark, sf):
    rows = w.table(spark, sf, "documents").select(
        "source", F.col("lang").alias("event_type"), F.col("doc_id").alias("fetched_at"), F.col("text").alias("message")
    )
    return samples.retain(rows, 60, 2000000)


@query(
    "latest_snapshot",
    """SELECT o_custkey AS key, o_orderkey AS snapshot, epoch_ms(o_orderdate) AS analysed_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
    FROM orders WHERE o_orderkey % 3 = 2 AND o_orderdate > TIMESTAMP '1998-12-01' - INTERVAL 30 DAY) WHERE rn = 1""",
)
def latest_snapshot(spark, sf):
    rows = w.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("snapshot"),
        F.col("o_orderdate").cast("timestamp").alias("analysed_at"), (F.col("o_orderkey") % 3).alias("version"),
    )
    latest = samples.latest_snapshot(rows, ["key"], 2, dt.datetime(1998, 12, 1), spread="snapshot")
    return latest.select("key", "snapshot", ms("analysed_at").alias("analysed_at"))


@query(
    "conversation_latest",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS rn FROM conversations) WHERE rn <= 2""",
)
def conversation_latest(spark, sf):
    from pactline.operators.ranking import top_n_per_group

    rows = w.table(spark, sf, "conversations")
    return top_n_per_group(rows, ["conv_id"], [F.desc("turn"), F.asc("role")], 2, spread="turn").select("conv_id", "turn", "role")


@query("sample_stats", sql("bus", "SELECT count(DISTINCT src || '@' || t) AS event_types, count(*) AS events FROM bus"))
def sample_stats(spark, sf):
    return samples.sample_stats(bus(spark, sf))


# --- flatten, profile, infer --------------------------------------------------------------------


@query(
    "observe_paths",
    sql("occ", "SELECT src AS source, t AS event_type, path, type, count(*) AS occurrences, count(DISTINCT e) AS events, count(CASE WHEN v = '\"\"' THEN 1 END) AS blanks FROM occ WHERE path <> '' GROUP BY ALL"),
)
def observe_paths(spark, sf):
    obs = ob.observe(bus(spark, sf))
    return obs.groupBy("source", "event_type", "path", "type").agg(
        F.count("*").alias("occurrences"), F.countDistinct("event_id").alias("events"), F.count_if("is_blank").alias("blanks")
    )


@query(
    "wide_array_paths",
    """WITH x AS (SELECT o_orderkey // 4000 AS e, o_orderkey % 700 AS m, CASE WHEN o_custkey % 3 = 0 THEN 'null' WHEN o_custkey % 3 = 1 THEN 'integer' ELSE 'string' END AS type FROM orders),
    f AS (SELECT e, m, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM x GROUP BY ALL)
    SELECT 'rows[].m' || m AS path, types, count(*) AS events FROM f GROUP BY ALL""",
)
def wide_array_paths(spark, sf):
    """Arrays whose elements all have members of their own: the fold is linear in the elements."""
    member = F.concat(
        F.lit('{"m'), (F.col("o_orderkey") % 700).cast("string"), F.lit('":'),
        F.when(F.col("o_custkey") % 3 == 0, "null").when(F.col("o_custkey") % 3 == 1, "7").otherwise('"x"'), F.lit("}"),
    )
    wide = w.table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 4000).alias("event_id")).agg(
        F.parse_json(F.concat(F.lit('{"rows":['), F.array_join(F.collect_list(member), ","), F.lit("]}"))).alias("detail")
    )
    paths = ob.event_paths(wide, ("event_id",)).where("path LIKE 'rows[].%'")
    return paths.groupBy("path", "types").agg(F.count("*").alias("events"))


@query(
    "dotted_names",
    """SELECT path, count(*) AS seen_in FROM (SELECT unnest(list_filter(['', 'a', 'a.b', CASE WHEN c_custkey % 3 > 0 THEN 'a%2Eb' END, CASE WHEN c_custkey % 5 = 0 THEN 'a.b%5B]' END],
    lambda p: p IS NOT NULL)) AS path FROM customer) GROUP BY ALL""",
)
def dotted_names(spark, sf):
    """A dot or bracket in a member name is no step: one row per event and path."""
    text = F.concat(
        F.lit("{"), F.when(F.col("c_custkey") % 3 > 0, '"a.b":1,').otherwise(""), F.lit('"a":{"b":"x"'),
        F.when(F.col("c_custkey") % 5 == 0, ',"b[]":2').otherwise(""), F.lit("}}"),
    )
    named = w.table(spark, sf, "customer").select(F.col("c_custkey").alias("event_id"), F.lit("c").alias("name"), F.parse_json(text).alias("detail"))
    return ob.profile(named, ("name",)).select("path", "seen_in")


@query(
    "field_profile",
    sql("occ", """SELECT src AS source, t AS event_type, path, count(DISTINCT e) AS seen_in, count(DISTINCT CASE WHEN v = '""' THEN e END) AS blank_in,
    count(DISTINCT CASE WHEN type = 'string' THEN e END) AS n_string, count(DISTINCT CASE WHEN type = 'integer' THEN e END) AS n_integer,
    count(DISTINCT CASE WHEN type = 'number' THEN e END) AS n_number, count(DISTINCT CASE WHEN type = 'null' THEN e END) AS n_null,
    count(DISTINCT CASE WHEN type = 'object' THEN e END) AS n_object, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM occ GROUP BY ALL"""),
)
def field_profile(spark, sf):
    prof = ob.profile(bus(spark, sf))
    return prof.select(
        "source", "event_type", "path", "seen_in", "blank_in", "n_string", "n_integer", "n_number", "n_null", "n_object",
        F.array_join("types", ",").alias("types"),
    )


@query(
    "field_examples",
    sql("occ", "SELECT src AS source, t AS event_type, path, type, arg_min(v, (ts, e, v)) AS example FROM occ WHERE type NOT IN ('object', 'array') GROUP BY ALL"),
)
def field_examples(spark, sf):
    obs = ob.observe(bus(spark, sf), ("event_id", "ts", "source", "event_type"))
    rows = obs.where("type NOT IN ('object', 'array')")
    return ob.field_examples(rows, ["source", "event_type"]).drop("approx_values")


@query(
    "field_values",
    sql("occ", "SELECT path, CASE WHEN path = 'amount' AND type = 'number' THEN regexp_replace(v, '[.]0$', '') ELSE v END AS value_json, count(DISTINCT e) AS events FROM occ WHERE type NOT IN ('object', 'array') GROUP BY ALL"),
)
def field_values(spark, sf):
    return ob.value_counts(ob.observe(bus(spark, sf)), [])


@query(
    "field_sample",
    sql("occ", """SELECT row_number() OVER (ORDER BY f, v) AS pos, v AS value_json, occurrences, n AS distinct_values, n > 32 AS capped FROM (
    SELECT v, min((ts, e)) AS f, count(*) AS occurrences, count(*) OVER () AS n FROM occ WHERE path = 'k' AND src = 'harbour-desk' GROUP BY v) ORDER BY f, v LIMIT 32"""),
)
def field_sample(spark, sf):
    events = ev.scan_events(bus(spark, sf), source="harbour-desk")
    obs = ob.observe(events, ("event_id", "ts"))
    return ob.field_sample(obs, "k").withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "field_coverage",
    sql("drift", """SELECT d.name, d.path, d.required, coalesce(p.seen_in, 0) AS seen_in FROM declared d LEFT JOIN prof p USING (name, path)"""),
)
def field_coverage(spark, sf):
    c = run(spark, sf)
    return ob.field_coverage(c.fields, c.profile, ["name"])


_INFER = """n AS (SELECT src, t, path, any_value(parent) AS parent, count(*) AS occ, list_sort(list(DISTINCT type) FILTER (type <> 'null')) AS types,
  count_if(type = 'null') AS nulls, count_if(type = 'object') AS objects FROM occ GROUP BY src, t, path),
ty AS (SELECT *, CASE WHEN len(types) = 1 THEN types[1] WHEN types = ['integer', 'number'] THEN 'number' END AS type FROM n)"""


@query(
    "infer_contract",
    sql("occ", """SELECT n.src AS source, n.t AS event_type, n.path, n.type, n.type IS NOT NULL AND n.nulls > 0 AS nullable,
    regexp_matches(n.path, '(?i)(id|ids|uuid|arn)$') AND n.path NOT LIKE '%[]' AND n.occ = p.objects AS required, CAST(NULL AS VARCHAR) AS format, n.occ AS occurrences
    FROM ty n JOIN ty p ON p.src = n.src AND p.t = n.t AND p.path = n.parent WHERE n.path <> ''""", _INFER),
)
def infer_contract(spark, sf):
    obs = ob.observe(bus(spark, sf), include_root=True)
    return infer.infer_contract(obs)


@query(
    "detect_format",
    """SELECT lang AS key, 'date-time' AS at_format, 'uuid' AS id_format, CASE WHEN bool_and(doc_id % 2 = 0) THEN 'email' END AS mail_format FROM documents GROUP BY lang""",
)
def detect_format(spark, sf):
    docs = w.table(spark, sf, "documents")
    shaped = docs.select(
        "doc_id", "lang",
        F.to_variant_object(
            F.struct(
                F.date_format(F.timestamp_seconds(F.col("doc_id") * 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
                F.regexp_replace(F.md5(F.col("doc_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").alias("id"),
                F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit("@mail.example"))).otherwise("none").alias("mail"),
            )
        ).alias("detail"),
    )
    obs = ob.observe(shaped, ("doc_id", "lang"))
    found = infer.detect_format(obs, ["lang"])
    wide = docs.groupBy("lang").agg(F.lit(1).alias("_one")).join(found, "lang", "left").groupBy(F.col("lang").alias("key")).agg(
        *[F.max(F.when(F.col("path") == p, F.col("format"))).alias(f"{p}_format") for p in ("at", "id", "mail")]
    )
    return wide


@query(
    "common_pattern",
    """SELECT 'customer' AS tbl, '^[A-Za-z]{8}#\\d{9}$' AS pattern WHERE (SELECT count(DISTINCT c_name) FROM customer) > 1
    UNION ALL SELECT 'supplier', '^[A-Za-z]{8}#\\d{9}$'
    UNION ALL SELECT 'tracking', '^\\d{7}-[0-9a-f]{16}$'
    UNION ALL SELECT 'brand', '^[A-Za-z]{5}#\\d{' || min(length(substr(p_brand, 7))) || ',' || max(length(substr(p_brand, 7))) || '}$' FROM part""",
)
def common_pattern(spark, sf):
    c = w.table(spark, sf, "customer").select(F.lit("customer").alias("tbl"), F.col("c_name").alias("v"))
    s = w.table(spark, sf, "supplier").select(F.lit("supplier").alias("tbl"), F.col("s_name").alias("v"))
    b = w.table(spark, sf, "part").select(F.lit("brand").alias("tbl"), F.col("p_brand").alias("v"))
    p = w.table(spark, sf, "pages").select(F.lit("url").alias("tbl"), F.col("url").alias("v"))
    t = bus(spark, sf).select(F.lit("tracking").alias("tbl"), F.try_variant_get("detail", "$.cargo.manifestId", "string").alias("v"))
    return shape.common_pattern(c.unionByName(s).unionByName(b).unionByName(p).unionByName(t), ["tbl"], "v")


@query(
    "propose_fields",
    sql("drift", """SELECT name, path, seen_in, CASE WHEN len(x) = 1 THEN x[1] END AS type, len(x) = 1 AND list_contains(types, 'null') AS nullable, coalesce(len(x) = 1 AND x[1] = 'object', FALSE) AS open
    FROM (SELECT *, list_filter(types, lambda y: y <> 'null') AS x FROM undeclared WHERE path NOT LIKE '%.%' AND path NOT LIKE '%[]%')"""),
)
def propose_fields(spark, sf):
    return infer.propose_fields(run(spark, sf).drift["undeclared"], top_level_only=True)


# --- drift --------------------------------------------------------------------------------------


@query("drift_undeclared", sql("drift", "SELECT name, path, array_to_string(types, ',') AS types, seen_in FROM undeclared"))
def drift_undeclared(spark, sf):
    return run(spark, sf).drift["undeclared"].withColumn("types", F.array_join("types", ","))


@query("drift_unused", sql("drift", "SELECT name, path, required FROM unused"))
def drift_unused(spark, sf):
    return run(spark, sf).drift["unused"]


@query(
    "drift_types",
    sql("drift", """SELECT w.name, w.path, array_to_string(any_value(w.declared), ' | ') AS declared, string_agg(DISTINCT w.type, ',' ORDER BY w.type) AS observed,
    any_value(p.seen_in) AS seen_in, count(DISTINCT w.e) AS mismatched_in,
    array_to_string(list_concat(list_filter(any_value(w.declared), lambda d: list_contains(any_value(p.types), d) OR (d = 'number' AND list_contains(any_value(p.types), 'integer'))), list_sort(list(DISTINCT w.type))), ',') AS suggested
    FROM wrong w JOIN prof p ON p.name = w.name AND p.path = w.path GROUP BY w.name, w.path"""),
)
def drift_types(spark, sf):
    return run(spark, sf).drift["types"].withColumns(
        {"observed": F.array_join("observed", ","), "suggested": F.array_join("suggested", ",")}
    )


@query(
    "drift_enum",
    sql("drift", "SELECT name, path, count(DISTINCT e) AS unexpected_in, count(DISTINCT v) AS distinct_unexpected, string_agg(DISTINCT v, ',' ORDER BY v) AS unexpected FROM outside WHERE v <> 'null' GROUP BY ALL"),
)
def drift_enum(spark, sf):
    c = run(spark, sf)
    obs = ob.observe(c.graded, ("name", "event_id"))
    return d.drift_enum(obs, c.fields).withColumn("unexpected", F.array_join("unexpected", ","))


@query("enum_values", sql("drift", "SELECT name, path, v AS value_json, count(DISTINCT e) AS events FROM outside WHERE v <> 'null' GROUP BY ALL"))
def enum_values(spark, sf):
    c = run(spark, sf)
    return d.enum_values(d.enum_hits(ob.observe(c.graded, ("name", "event_id")), c.fields))


@query("drift_missing", sql("drift", "SELECT name, path, seen_in, carriers, carriers - seen_in AS absent_in FROM missing"))
def drift_missing(spark, sf):
    return run(spark, sf).drift["missing"]


@query("drift_blank", sql("drift", "SELECT name, path, seen_in, blank_in AS empty_in FROM blank"))
def drift_blank(spark, sf):
    return run(spark, sf).drift["blank"]


# --- violations and issues ----------------------------------------------------------------------


@query("violations", sql("viol", "SELECT name, class, path, constraint_at AS \"constraint\", e AS event_id, count(*) AS n FROM viol GROUP BY ALL"))
def violations(spark, sf):
    return run(spark, sf).violations.groupBy("name", "class", "path", "constraint", "event_id").agg(F.count("*").alias("n"))


@query(
    "format_violations",
    sql("prof", "SELECT e AS event_id, '\"' || tracking || '\"' AS value_json FROM bus WHERE src = 'Tide Tables' AND t = 'click' AND meta = 'full'"),
)
def format_violations(spark, sf):
    c = run(spark, sf)
    obs = ob.observe(c.graded, ("name", "event_id"))
    return vi.format_violations(obs, c.fields).select("event_id", "value_json")


@query("failure_groups", sql("viol", "SELECT name, class, path, constraint_at AS \"constraint\", affected, occurrences FROM fail"))
def failure_groups(spark, sf):
    return run(spark, sf).failures.select("name", "class", "path", "constraint", "affected", "occurrences")


@query(
    "verdicts",
    sql("viol", """SELECT name, sampled, sampled - coalesce(failed, 0) - coalesce(undecided, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(undecided, 0) AS undecided FROM sampled
    LEFT JOIN (SELECT name, count(DISTINCT e) AS failed FROM viol GROUP BY ALL) USING (name) LEFT JOIN open_ USING (name)"""),
)
def verdicts(spark, sf):
    return run(spark, sf).verdicts


@query("issues", sql("issues", "SELECT name, key, kind, path, severity, affected, sampled, rejects FROM issues"))
def issues(spark, sf):
    return run(spark, sf).issues.select("name", "key", "kind", "path", "severity", "affected", "sampled", "rejects")


@query("issue_ranking", sql("issues", "SELECT name, key, severity, affected, rank FROM ranked"))
def issue_ranking(spark, sf):
    return run(spark, sf).ranked.select("name", "key", "severity", "affected", F.col("rank").cast("bigint").alias("rank"))


_SHARE = "CASE WHEN {n} = 0 OR sampled = 0 THEN '0%' ELSE CAST(greatest(CAST(round({n} * 100.0 / sampled) AS BIGINT), 1) AS VARCHAR) || '%' END"


_SAID = """wt AS (SELECT name, path, any_value(array_to_string(declared, ' | ')) AS dec, string_agg(DISTINCT type, ' | ' ORDER BY type) AS obs FROM wrong GROUP BY ALL),
oe AS (SELECT name, path, string_agg(DISTINCT '`' || v || '`', ', ' ORDER BY '`' || v || '`') AS vals FROM outside WHERE v <> 'null' GROUP BY ALL),
told AS (SELECT i.*, wt.dec, wt.obs, oe.vals, array_to_string(u.types, ' | ') AS seen, '`' || i.path || '`' AS p FROM issues i
  LEFT JOIN wt ON wt.name = i.name AND wt.path = i.path LEFT JOIN oe ON oe.name = i.name AND oe.path = i.path
  LEFT JOIN undeclared u ON u.name = i.name AND u.path = i.path)"""


@query(
    "issue_text",
    sql("issues", f"""SELECT name, key, CASE kind WHEN 'undeclared' THEN 'unknown field ' || p || ': ' || {_SHARE.format(n='stat')}
    WHEN 'wrongType' THEN 'type of ' || p || ': contract ' || dec || ', traffic ' || obs || ' in ' || {_SHARE.format(n='stat')}
    WHEN 'outsideEnum' THEN 'values of ' || p || ' beyond its list: ' || vals
    WHEN 'missingRequired' THEN 'mandatory ' || p || ' left out: ' || {_SHARE.format(n='affected')}
    WHEN 'emptyRequired' THEN 'mandatory ' || p || ' empty: ' || {_SHARE.format(n='stat')}
    WHEN 'neverSeen' THEN 'no traffic for ' || p END AS summary,
    CASE WHEN kind = 'wrongType' THEN 'Agree on one type: ' || dec || ' in the producer, or ' || obs || ' in the contract.'
    WHEN kind = 'outsideEnum' THEN 'Extend the list, or stop sending these values.'
    WHEN kind = 'missingRequired' THEN 'Send ' || p || ' always, or drop it from the mandatory fields.'
    WHEN kind = 'emptyRequired' THEN 'Fill ' || p || ' at the source, or set a least length.'
    WHEN kind = 'undeclared' AND rejects THEN 'Closed object: add ' || p || ' to it, or its events stay invalid.'
    WHEN kind = 'undeclared' THEN 'Describe ' || p || ' (' || seen || ') so that it is checked.'
    WHEN kind = 'neverSeen' THEN 'Look at a longer span; then retire the field.'
    ELSE 'Loosen the constraint, or correct the source.' END AS action FROM told""", _SAID),
)
def issue_text(spark, sf):
    """The words of every issue; a rejection quotes an event, so only its advice is compared."""
    said = F.when(F.col("kind") != "rejected", F.col("summary"))
    return run(spark, sf).issues.select("name", "key", said.alias("summary"), "action")


_READS = """r AS (SELECT * FROM (VALUES ('harbour-desk@view','a.ts','cargo.manifestId.part'),('harbour-desk@view','a.ts','status'),('harbour-desk@view','b.ts','cargo'),
('harbour-desk@view','b.ts','items[].sku'),('billing-invoices@purchase','c.ts','amount')) x(name, file, path)),
rel AS (SELECT i.name, i.path, r.file, max(CASE WHEN r.p = i.p OR starts_with(r.p, i.p || '.') THEN 1 ELSE 0 END) AS reads
  FROM (SELECT DISTINCT name, path, replace(path, '[]', '') AS p FROM issues WHERE path <> '') i JOIN (SELECT *, replace(path, '[]', '') AS p FROM r) r
  ON r.name = i.name AND (r.p = i.p OR starts_with(r.p, i.p || '.') OR starts_with(i.p, r.p || '.')) GROUP BY ALL),
who AS (SELECT name, path, sum(reads) AS readers, sum(1 - reads) AS indirect FROM rel GROUP BY ALL),
h AS (SELECT name, count(DISTINCT file) AS handlers FROM r GROUP BY ALL),
graded AS (SELECT i.*, h.handlers, coalesce(w.readers, 0) AS readers, coalesce(w.indirect, 0) AS indirect FROM issues i LEFT JOIN h USING (name) LEFT JOIN who w USING (name, path))"""


def _bus_reads(spark):
    rows = [
        ("harbour-desk@view", "a.ts", "cargo.manifestId.part"), ("harbour-desk@view", "a.ts", "status"),
        ("harbour-desk@view", "b.ts", "cargo"), ("harbour-desk@view", "b.ts", "items[].sku"),
        ("billing-invoices@purchase", "c.ts", "amount"),
    ]
    return spark.createDataFrame(rows, "name string, file string, path string")


@query(
    "reader_impact",
    sql("issues", """SELECT name, key, handlers, CASE WHEN handlers IS NOT NULL THEN CAST(readers AS BIGINT) END AS readers, CASE WHEN handlers IS NOT NULL THEN CAST(indirect AS BIGINT) END AS indirect,
    CASE WHEN handlers IS NULL THEN severity WHEN readers > 0 THEN CASE severity WHEN 'info' THEN 'warning' ELSE 'error' END
    WHEN indirect = 0 THEN CASE severity WHEN 'error' THEN 'warning' ELSE 'info' END ELSE severity END AS severity FROM graded""", _READS),
)
def reader_impact(spark, sf):
    graded = impact.grade_by_readers(run(spark, sf).issues, _bus_reads(spark))
    return graded.select("name", "key", "handlers", "readers", "indirect", "severity")


@query(
    "suggest_repairs",
    sql("issues", """SELECT name, key, CASE WHEN path = '' OR path LIKE '%[]' THEN NULL WHEN kind = 'rejected' THEN CASE WHEN key LIKE '%/format' THEN 'constrainPattern' END
    ELSE CASE kind WHEN 'wrongType' THEN 'widenType' WHEN 'outsideEnum' THEN 'extendEnum' WHEN 'missingRequired' THEN 'dropRequired' WHEN 'emptyRequired' THEN 'requireNonEmpty' WHEN 'undeclared' THEN 'declareField' END END AS fix,
    CASE WHEN key LIKE '%/format' THEN '^\\d{7}-[0-9a-f]{16}$' END AS pattern FROM issues"""),
)
def suggest_repairs(spark, sf):
    c = run(spark, sf)
    fixed = iss.suggest_repairs(c.issues, c.occurrences)
    return fixed.select("name", "key", F.col("fix.kind").alias("fix"), F.col("fix.pattern").alias("pattern"))


@query(
    "repaired_fields",
    sql("issues", """SELECT name, path, CASE path WHEN 'amount' THEN 'number,null,string' WHEN 'shipperId' THEN 'string,integer' ELSE array_to_string(types, ',') END AS types,
    path = 'amount' AS required, CASE WHEN path = 'status' THEN '"loaded","sailed","held"' END AS enum, CASE WHEN path = 'shipperId' THEN CAST(1 AS BIGINT) END AS min_len
    FROM declared WHERE name = 'harbour-desk@view'
    UNION ALL SELECT 'harbour-desk@view', x.path, x.types, FALSE, NULL, NULL FROM (VALUES ('beta', 'boolean'), ('k', 'integer')) x(path, types)"""),
)
def repaired_fields(spark, sf):
    c = ck.Check(w.bus(spark, sf), w.bus_contracts(spark), ["harbour-desk@view"])
    edited, _ = repairs.apply_repairs(c.fields, c.issues.select("name", "path", "fix"), enum_values=c.enum_values)
    return edited.where("depth > 0").select(
        "name", "path", F.array_join("types", ",").alias("types"), "required",
        F.when(F.col("enum_json").isNotNull(), F.array_join("enum_json", ",")).alias("enum"), "min_len",
    )


@query(
    "refused_repairs",
    sql("drift", "SELECT DISTINCT name, path, 'widenType' AS kind, 'declared by a reference' AS reason FROM wrong WHERE name = 'harbour-desk@view' AND path = 'cargo'"),
)
def refused_repairs(spark, sf):
    c = ck.Check(w.bus(spark, sf), w.bus_contracts(spark), ["harbour-desk@view"])
    return repairs.apply_repairs(c.fields, c.issues.select("name", "path", "fix"), enum_values=c.enum_values)[1]


@query(
    "repaired_enum",
    """SELECT path, count(*) AS allowed, min(v) AS lowest, max(v) AS highest FROM (SELECT 'day' AS path, '"' || strftime(o_orderdate, '%Y-%m-%d') || '"' AS v FROM orders UNION SELECT 'day', '"never"') GROUP BY path""",
)
def repaired_enum(spark, sf):
    """More values outside the enum than an issue lists: the repair takes them all."""
    days = w.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("orders").alias("source"),
        F.lit("placed").alias("event_type"),
        F.to_variant_object(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))).alias("detail"),
    )
    listed = w.document("orders", "placed", {"Payload": {"type": "object", "properties": {"day": {"type": "string", "enum": ["never"]}}}})
    contract = parse_contracts(spark.createDataFrame([("orders@placed", 1, listed)], "name string, version int, content string"))[0]
    c = ck.Check(days, contract)
    edited, _ = repairs.apply_repairs(c.fields, c.issues.select("name", "path", "fix"), enum_values=c.enum_values)
    return edited.where("path = 'day'").select(
        "path", F.size("enum_json").cast("bigint").alias("allowed"), F.array_min("enum_json").alias("lowest"), F.array_max("enum_json").alias("highest")
    )


@query(
    "events_for_issue",
    sql("bus", "SELECT e AS event_id FROM bus WHERE src = 'harbour-desk' AND t = 'view' AND amount IN ('null', 'string') ORDER BY ts DESC, e LIMIT 25"),
)
def events_for_issue(spark, sf):
    return ck.events_for_issue(w.bus(spark, sf), w.bus_contracts(spark), "harbour-desk@view", "wrongType:amount").select("event_id")


@query(
    "events_for_issue_newest",
    sql("bus", f"SELECT e AS event_id FROM bus WHERE ms >= {START_MS} AND ms < {END_MS} AND src = 'Tide Tables' AND t = 'click' AND k > 50 ORDER BY ts DESC, e LIMIT 25"),
)
def events_for_issue_newest(spark, sf):
    found = ck.events_for_issue(_log(spark, sf), w.bus_contracts(spark), "Tide-Tables@click", "rejected:k:/properties/k/maximum", start=_WINDOW[0], end=_WINDOW[1])
    return found.select("event_id")


_UNREG = """left_over AS (SELECT src, t, count(*) AS n FROM bus WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.src = bus.src AND m.t = bus.t)
  AND NOT (src = 'billing-invoices' AND t = 'error') GROUP BY ALL)"""


@query(
    "unregistered_issues",
    sql("prof", """SELECT src || '@' || t AS name, 'unregistered' AS key, 'warning' AS severity, n AS affected, n || CASE WHEN n = 1 THEN ' event' ELSE ' events' END || ' on the bus' AS observed FROM left_over""", _UNREG),
)
def unregistered_issues(spark, sf):
    return run(spark, sf).unregistered.select("name", "key", "severity", "affected", "observed")


@query(
    "unregistered_example",
    sql("prof", """SELECT src AS source, t AS event_type, arg_max(e, (ts, -e)) AS newest FROM bus SEMI JOIN left_over USING (src, t) GROUP BY ALL""", _UNREG),
)
def unregistered_example(spark, sf):
    c = run(spark, sf)
    types = c.keys.join(c.matches, ["source", "event_type"], "left_anti").select("source", "event_type")
    shown = iss.with_example(c.events, types)
    # The example is found again by its payload: the newest event of the type carries it.
    back = c.events.select("source", "event_type", "event_id", "ts", F.to_json("detail").alias("example"))
    return shown.join(back, ["source", "event_type", "example"]).groupBy("source", "event_type").agg(
        F.max_by("event_id", F.struct("ts", -F.col("event_id"))).alias("newest")
    )


@query(
    "concerns",
    """SELECT 'n' || c_nationkey AS name, 'concern:' || CASE WHEN c_custkey % 2 = 0 THEN 'event' ELSE c_mktsegment END AS key, count(*) AS raised FROM customer GROUP BY ALL""",
)
def concerns(spark, sf):
    rows = w.table(spark, sf, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("path"),
        F.lit("unclear").alias("summary"), F.col("c_name").alias("detail"),
    )
    return iss.concerns_to_issues(rows).groupBy("name", "key").agg(F.count("*").alias("raised"))


_RES = """res AS (SELECT name, key, CASE WHEN kind = 'undeclared' THEN 'fixed' ELSE 'filed' END AS how FROM issues WHERE kind IN ('undeclared', 'neverSeen'))"""


def _resolutions(found):
    return found.where("kind IN ('undeclared', 'neverSeen')").select(
        "name", "key", F.when(F.col("kind") == "undeclared", "fixed").otherwise("filed").alias("how")
    )


@query(
    "outstanding_issues",
    sql("issues", """SELECT coalesce(o.name, r.name) AS name, coalesce(open, 0) AS open, coalesce(drifting, 0) AS drifting, coalesce(fixed, 0) AS fixed, coalesce(filed, 0) AS filed FROM
    (SELECT name, count(*) AS open, count_if(severity <> 'info') AS drifting FROM issues ANTI JOIN res USING (name, key) GROUP BY ALL) o FULL JOIN
    (SELECT name, count_if(how = 'fixed') AS fixed, count_if(how <> 'fixed') AS filed FROM res GROUP BY ALL) r ON o.name = r.name""", _RES),
)
def outstanding_issues(spark, sf):
    found = run(spark, sf).issues
    return iss.outstanding_counts(found, _resolutions(found))


@query(
    "sibling_groups",
    sql("issues", """SELECT name, kind, parent, count(*) AS fields, string_agg(path, ',' ORDER BY path) AS paths, CASE min(CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity
    FROM (SELECT *, CASE WHEN kind = 'undeclared' AND path LIKE '%.%' THEN regexp_replace(path, '\\.[^.]*$', '') END AS parent, CASE WHEN NOT (kind = 'undeclared' AND path LIKE '%.%') THEN key END AS alone FROM issues) GROUP BY name, kind, parent, alone"""),
)
def sibling_groups(spark, sf):
    return iss.group_siblings(run(spark, sf).issues).withColumn("paths", F.array_join("paths", ","))


@query(
    "issue_examples",
    sql("issues", """SELECT name, key, row_number() OVER (PARTITION BY name, key ORDER BY priority, value_json) AS pos, value_json FROM (
    SELECT i.name, i.key, v.priority, v.v AS value_json, row_number() OVER (PARTITION BY i.name, i.key ORDER BY v.priority, v.v) AS rn FROM issues i JOIN vals v USING (name, path)) WHERE rn <= 10""",
    """vals AS (SELECT DISTINCT name, path, 0 AS priority, v FROM outside WHERE v <> 'null' UNION ALL
    SELECT name, path, 1, v FROM (SELECT DISTINCT name, path, v FROM g WHERE type NOT IN ('object', 'array', 'null')))"""),
)
def issue_examples(spark, sf):
    c = run(spark, sf)
    obs = ob.observe(c.graded, ("name", "event_id"))
    zero = F.lit(0)
    first = d.enum_values(d.enum_hits(obs, c.fields)).select("name", "path", "value_json", F.lit(0).alias("priority"), zero.alias("pos"))
    rest = obs.where("type NOT IN ('object', 'array', 'null')").select(
        "name", "path", "value_json"
    ).distinct().select("name", "path", "value_json", F.lit(1).alias("priority"), zero.alias("pos"))
    shown = iss.issue_examples(c.issues, first.unionByName(rest))
    return shown.withColumn("pos", F.col("pos").cast("bigint"))


# --- registry health ----------------------------------------------------------------------------


@query(
    "contract_matching",
    sql("prof", """SELECT name, src AS source, t AS event_type, CASE WHEN src || '@' || t <> name THEN src || '@' || t END AS wire_identity FROM matched
    UNION ALL SELECT 'billing-invoices@error', 'billing-invoices', 'error', NULL"""),
)
def contract_matching(spark, sf):
    return run(spark, sf).matches


_HEALTH = """cnt AS (SELECT name, count_if(kind = 'undeclared') AS undeclared, count_if(kind = 'wrongType') AS type_mismatches, count_if(kind = 'outsideEnum') AS enum_drift,
  count_if(kind = 'missingRequired') AS missing_required, count_if(kind = 'emptyRequired') AS empty_required FROM drift GROUP BY ALL),
vd AS (SELECT name, sampled, coalesce(failed, 0) AS failed, coalesce(undecided, 0) AS undecided FROM sampled LEFT JOIN (SELECT name, count(DISTINCT e) AS failed FROM viol GROUP BY ALL) USING (name) LEFT JOIN open_ USING (name)),
names AS (SELECT DISTINCT name FROM declared UNION SELECT 'billing-invoices@error'),
h0 AS (SELECT n.name, m.src IS NOT NULL OR n.name = 'billing-invoices@error' AS live, n.name = 'billing-invoices@error' AS broken,
  CASE WHEN n.name = 'billing-ledger@signup' THEN (SELECT count(*) FROM b WHERE ext) WHEN n.name = 'billing-invoices@error' THEN (SELECT count(*) FROM bus WHERE src = 'billing-invoices' AND t = 'error') ELSE coalesce(v.sampled, 0) END AS observed,
  coalesce(v.sampled, 0) AS sampled, coalesce(v.failed, 0) AS failed, coalesce(v.undecided, 0) AS undecided, coalesce(undeclared, 0) AS undeclared, coalesce(type_mismatches, 0) AS type_mismatches, coalesce(enum_drift, 0) AS enum_drift,
  coalesce(missing_required, 0) AS missing_required, coalesce(empty_required, 0) AS empty_required,
  CASE WHEN m.src || '@' || m.t <> n.name THEN m.src || '@' || m.t END AS wire_identity
  FROM names n LEFT JOIN matched m USING (name) LEFT JOIN vd v USING (name) LEFT JOIN cnt USING (name)),
health AS (SELECT *, CASE WHEN NOT live THEN 'noTraffic' WHEN failed > 0 THEN 'failing' WHEN broken THEN 'error'
  WHEN undeclared + type_mismatches + enum_drift + empty_required > 0 THEN 'drifting' WHEN undecided > 0 THEN 'undecided' ELSE 'ok' END AS status FROM h0)"""
_NUM = "observed, sampled, sampled - failed - undecided AS passed, failed, undecided, undeclared, type_mismatches, enum_drift, missing_required, empty_required"


def _report(spark, sf):
    return he.health_report(w.all_channels(spark, sf), w.bus_contracts(spark))


@query("health_report", sql("issues", f"SELECT name, status, {_NUM}, wire_identity FROM health", _HEALTH))
def health_report(spark, sf):
    numbers = ["observed", "sampled", "passed", "failed", "undecided", *he.DRIFT_KINDS]
    return _report(spark, sf).select("name", "status", *numbers, "wire_identity")


@query(
    "health_headline",
    sql("issues", "SELECT name, key, severity FROM ranked WHERE rank = 1"),
)
def health_headline(spark, sf):
    return run(spark, sf).ranked.where("rank = 1").select("name", "key", "severity")


@query(
    "redacted_only",
    sql("bus", "SELECT 'billing-ledger@signup' AS name, 'noTraffic' AS status, count(*) AS observed, CAST(0 AS BIGINT) AS sampled, 'redacted copies only: ' || count(*) AS headline FROM b WHERE ext"),
)
def redacted_only(spark, sf):
    return _report(spark, sf).where("name = 'billing-ledger@signup'").select("name", "status", "observed", "sampled", "headline")


_MISS = _HEALTH + """, miss AS (SELECT src || '@' || t AS name, count(*) AS observed FROM bus WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.src = bus.src AND m.t = bus.t)
  AND NOT (src = 'billing-invoices' AND t = 'error') GROUP BY ALL),
rows_ AS (SELECT name, status, observed, failed, undeclared + type_mismatches + enum_drift + missing_required + empty_required AS drift_n FROM health
  UNION ALL SELECT name, 'missing', observed, 0, 0 FROM miss)"""


def _rows(spark, sf):
    events, contracts = w.all_channels(spark, sf), w.bus_contracts(spark)
    # One row a type; the views below read it several times.
    return cut(he.with_missing(he.health_report(events, contracts), he.unregistered_types(events, contracts)))


@query("unregistered_types", sql("issues", "SELECT name AS event_key, observed FROM miss", _MISS))
def unregistered_types(spark, sf):
    return he.unregistered_types(w.all_channels(spark, sf), w.bus_contracts(spark)).select("event_key", "observed")


@query(
    "status_counts",
    sql("issues", """SELECT s.status, count(r.name) AS rows, round(count(r.name) / (SELECT count(*) FROM rows_), 6) AS share FROM (VALUES ('missing'), ('failing'), ('error'), ('drifting'), ('undecided'), ('ok'), ('noTraffic')) s(status)
    LEFT JOIN rows_ r USING (status) GROUP BY ALL""", _MISS),
)
def status_counts(spark, sf):
    return he.status_counts(_rows(spark, sf)).withColumn("share", F.round("share", 6))


@query(
    "busiest_types",
    sql("issues", "SELECT name, status, observed, round(observed / (SELECT count(*) FROM bus), 6) AS share FROM rows_ WHERE observed > 0 ORDER BY observed DESC, name LIMIT 12", _MISS),
)
def busiest_types(spark, sf):
    top = he.busiest_types(_rows(spark, sf), samples.sample_stats(bus(spark, sf)))
    return top.withColumn("share", F.round("share", 6))


@query(
    "drift_breakdown",
    sql("issues", """SELECT kind, CAST(sum(n) AS BIGINT) AS total, count_if(n > 0) AS contracts FROM (UNPIVOT (SELECT name, undeclared, type_mismatches, enum_drift, missing_required, empty_required FROM health)
    ON undeclared, type_mismatches, enum_drift, missing_required, empty_required INTO NAME kind VALUE n) GROUP BY ALL""", _HEALTH),
)
def drift_breakdown(spark, sf):
    return he.drift_breakdown(_report(spark, sf))


@query(
    "report_sorted",
    sql("issues", "SELECT name, drift_n, row_number() OVER (ORDER BY drift_n DESC, name) AS pos FROM rows_", _MISS),
)
def report_sorted(spark, sf):
    from pyspark.sql import Window as W

    # A report has one row per contract, so numbering it is small.
    ordered = he.sort_report(_rows(spark, sf), "drift", descending=True).withColumn("drift_n", he.drift_total())
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("drift_n"), "name")
    return ordered.select("name", "drift_n", F.row_number().over(order).cast("bigint").alias("pos"))


_ADDR = _MISS + """, addr AS (SELECT name, status, CASE WHEN name = 'billing-ledger@view' THEN 'marked' WHEN status = 'missing' AND name LIKE 'Tide%' THEN 'registered' WHEN name = 'harbour-desk@view' THEN 'saved' END AS addressed FROM rows_)"""


def _addressed(spark, sf):
    rows = _rows(spark, sf).withColumn("last_modified", F.lit("v1"))
    live = rows.where("name LIKE 'Tide%' OR name LIKE 'harbour%@view'").select(
        "name", F.when(F.col("name").startswith("harbour"), "v2").otherwise("v1").alias("last_modified")
    )
    marks = rows.where("name = 'billing-ledger@view'").select("name")
    return he.addressed(rows, live, marks, T0, T0 + dt.timedelta(hours=25), 1440)


@query("addressed_rows", sql("issues", "SELECT name, addressed, TRUE AS stale FROM addr", _ADDR))
def addressed_rows(spark, sf):
    return _addressed(spark, sf).select("name", "addressed", "stale")


@query(
    "fileable_rows",
    sql("issues", "SELECT name, status FROM addr WHERE status IN ('missing', 'failing', 'error', 'drifting') AND addressed IS NULL AND lower(name) LIKE '%billing%'", _ADDR),
)
def fileable_rows(spark, sf):
    return he.fileable(he.filter_report(_addressed(spark, sf), text="Billing", hide_done=True)).select("name", "status")


@query("report_filter", sql("issues", "SELECT name, status FROM addr WHERE status IN ('failing', 'ok') AND addressed IS NULL", _ADDR))
def report_filter(spark, sf):
    return he.filter_report(_addressed(spark, sf), ("failing", "ok"), hide_done=True).select("name", "status")


@query("identity_mismatches", sql("prof", "SELECT name, src || '@' || t AS wire_identity FROM matched WHERE src || '@' || t <> name"))
def identity_mismatches(spark, sf):
    return he.identity_mismatches(_report(spark, sf))


@query(
    "issues_for_contracts",
    sql("issues", """SELECT name, key, affected, CAST(NULL AS VARCHAR) AS note FROM ranked WHERE name IN ('harbour-desk@view')
    UNION ALL SELECT 'orders-api@nothing', NULL, NULL, 'no events were sampled'"""),
)
def issues_for_contracts(spark, sf):
    found = he.issues_for(w.bus(spark, sf), w.bus_contracts(spark), ["harbour-desk@view", "orders-api@nothing"])
    return found.select("name", "key", "affected", "note")


_EACH = """each_ AS (
  SELECT DISTINCT name, e, 'undeclared:' || path AS key FROM g WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.name = g.name AND d.path = g.path)
  UNION SELECT DISTINCT name, e, 'wrongType:' || path FROM wrong
  UNION SELECT DISTINCT name, e, 'outsideEnum:' || path FROM outside WHERE v <> 'null'
  UNION SELECT DISTINCT g.name, e, 'emptyRequired:' || g.path FROM g JOIN declared d ON d.name = g.name AND d.path = g.path WHERE d.required AND g.v = '""'
  UNION SELECT DISTINCT name, e, 'missingRequired:' || path FROM viol WHERE class = 'missingRequired'
  UNION SELECT DISTINCT name, e, 'rejected:' || path || ':' || constraint_at FROM viol WHERE class = 'other'
  UNION SELECT src || '@' || t, e, 'unregistered' FROM bus WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.src = bus.src AND m.t = bus.t) AND NOT (src = 'billing-invoices' AND t = 'error'))"""


@query("check_each_event", sql("viol", "SELECT name, e AS event_id, key FROM each_", _EACH))
def check_each_event(spark, sf):
    return ck.check_each(w.bus(spark, sf), w.bus_contracts(spark)).select("name", "event_id", "key").distinct()


@query(
    "check_draft",
    sql("bus", f"""SELECT key, count(*) AS affected, any_value((SELECT count(*) FROM x)) AS sampled FROM (
    SELECT 'wrongType:shipperId' AS key FROM x WHERE client = 'integer' UNION ALL SELECT 'rejected:k:/properties/k/minimum' FROM x WHERE k < 10
    UNION ALL SELECT 'undeclared:' || p FROM x, (VALUES ('amount'), ('status'), ('items')) v(p) UNION ALL SELECT 'undeclared:cargo' FROM x WHERE meta <> 'absent'
    UNION ALL SELECT 'undeclared:cargo.manifestId' FROM x WHERE meta = 'full' UNION ALL SELECT 'undeclared:beta' FROM x WHERE beta
    UNION ALL SELECT 'undeclared:' || p FROM x, (VALUES ('items[]'), ('items[].sku'), ('items[].qty')) v(p) WHERE n > 0) GROUP BY ALL""",
    f"x AS (SELECT * FROM bus WHERE src = 'harbour-desk' AND t = 'purchase' AND ms >= {START_MS + DAY} AND ms < {START_MS + 20 * DAY})"),
)
def check_draft(spark, sf):
    draft = w.document(
        "harbour-desk", "purchase",
        {"Payload": {"type": "object", "properties": {"shipperId": {"type": "string"}, "k": {"type": "integer", "minimum": 10}}}},
    )
    c = ck.check_contract(w.bus(spark, sf), "harbour-desk@purchase", draft, at(DAY), at(20 * DAY))
    return c.issues.select("key", "affected", "sampled")
