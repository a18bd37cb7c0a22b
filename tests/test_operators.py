"""Inference, samples, versions, routing, readers, logs on literal cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pactline.operators import contracts as ct
from pactline.operators import impact, infer, routing, samples, topology
from pactline.operators import observe as ob
from pactline.operators import readers as rd
from pactline.operators import versions as ver
from pactline.operators.intervals import join_points, union_intervals
from pactline.operators.lint import lint
from pactline.plans.check import Check
from pactline.sources import applog
from pactline.sources import events as ev
from pactline.sources.contracts_io import parse_contracts, read_contracts, write_contracts

INFER = {
    "i@scalars": [{"id": "a", "n": 1, "f": 1.5, "b": True}, {"id": "b", "n": 2, "f": 2.5, "b": False}],
    "i@nulls": [{"a": None, "b": "x"}, {"a": "y", "b": None}, {"a": None, "c": None}],
    "i@mixed": [{"v": 1, "w": 1, "o": {"x": 1}}, {"v": "1", "w": 1.5, "o": "s"}],
    "i@nested": [{"m": {"orderId": "1", "x": 1}}, {"m": {"orderId": "2"}}, {}],
    "i@arrays": [{"l": [{"sku": "a", "itemId": 1}, {"itemId": 2}], "e": []}],
    "i@formats": [
        {"at": "2026-01-01T12:00:00Z", "u": "123e4567-e89b-12d3-a456-426614174000", "m": "a@b.co", "s": "2026-01-01T12:00:00Z"},
        {"at": "2026-01-02 12:00:00.1", "u": "223e4567-e89b-12d3-a456-426614174000", "m": "cc@d.org", "s": "no"},
    ],
}


@pytest.fixture(scope="module")
def inferred(make_events):
    obs = ob.observe(make_events(INFER), ("event_id", "source", "event_type"), include_root=True)
    rows = infer.infer_contract(obs).collect()
    return {(r["event_type"], r["path"]): r for r in rows}


def test_inferred_types(inferred):
    assert [inferred["scalars", p]["type"] for p in ("id", "n", "f", "b")] == ["string", "integer", "number", "boolean"]
    assert inferred["scalars", "id"]["required"] and not inferred["scalars", "n"]["required"]
    assert (inferred["nulls", "a"]["type"], inferred["nulls", "a"]["nullable"]) == ("string", True)
    assert inferred["nulls", "c"]["type"] is None
    assert inferred["mixed", "v"]["type"] is None and inferred["mixed", "w"]["type"] == "number"
    assert ("mixed", "o.x") not in inferred and inferred["mixed", "o"]["type"] is None
    assert inferred["nested", "m.orderId"]["required"] and not inferred["nested", "m.x"]["required"]
    assert inferred["arrays", "l[].itemId"]["required"] and not inferred["arrays", "l[].sku"]["required"]
    assert inferred["arrays", "e"]["type"] == "array" and ("arrays", "e[]") not in inferred


def test_inferred_formats(inferred):
    assert [inferred["formats", p]["format"] for p in ("at", "u", "m", "s")] == ["date-time", "uuid", "email", None]


def test_a_draft_accepts_the_events_it_came_from(inferred, make_events, make_contracts):
    """Top-level fields of each draft as a document, checked against the same events."""
    types = {}
    for (event_type, path), r in inferred.items():
        if "." in path or "[]" in path or event_type == "formats":
            continue
        schema = types.setdefault(f"i@{event_type}", {"Payload": {"type": "object", "properties": {}, "required": []}})["Payload"]
        field = {} if r["type"] is None else {"type": r["type"]} | ({"nullable": True} if r["nullable"] else {})
        schema["properties"][path] = field
        if r["required"]:
            schema["required"].append(path)
    c = Check(make_events({k: v for k, v in INFER.items() if k in types}), make_contracts(types))
    assert c.verdicts.agg(F.sum("failed")).first()[0] == 0


def test_field_sample_and_values(make_events):
    events = make_events({"f@s": [{"l": ["b", "b", "a"]}, {"l": ["a"]}, {"l": [1]}]})
    obs = ob.observe(events, ("event_id", "ts"))
    rows = ob.field_sample(obs, "l[]", cap=2).orderBy("pos").collect()
    assert [(r["value_json"], r["occurrences"], r["distinct_values"], r["capped"]) for r in rows] == [('"a"', 2, 3, True), ('"b"', 2, 3, True)]
    counts = {r["value_json"]: r["events"] for r in ob.value_counts(obs, []).collect()}
    assert counts == {'"a"': 2, '"b"': 1, "1": 1}


def test_slices_and_stripes(spark):
    day, minute = 86_400_000, 60_000
    w = spark.createDataFrame([("week", 0, 7 * day), ("short", 0, 20 * minute), ("odd", 0, 103)], "w string, start_ms long, end_ms long")
    slices = {r["w"]: (r["n"], r["lo"], r["hi"]) for r in ev.time_slices(w).groupBy("w").agg(F.count("*").alias("n"), F.min("from_ms").alias("lo"), F.max("to_ms").alias("hi")).collect()}
    assert slices["week"] == (28, 0, 7 * day) and slices["short"] == (4, 0, 20 * minute)
    stripes = samples.stripe_ranges(w.where("w = 'odd'")).orderBy("stripe").collect()
    assert len(stripes) == 8 and stripes[0]["from_ms"] == 0 and stripes[-1]["to_ms"] == 103
    assert all(a["to_ms"] == b["from_ms"] for a, b in zip(stripes, stripes[1:]))


def test_intervals_against_brute_force(spark):
    import random

    rng = random.Random(7)
    spans = [(k, s := rng.randrange(0, 10**9), s + rng.randrange(0, 10**8)) for k in ("hot",) * 60 + ("b", "c") for _ in range(2)]
    got = {(r["k"], r["start_ms"], r["end_ms"]) for r in union_intervals(spark.createDataFrame(spans, "k string, start_ms long, end_ms long"), ["k"]).collect()}
    want = set()
    for key in {k for k, _, _ in spans}:
        merged = []
        for s, e in sorted((s, e) for k, s, e in spans if k == key):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want |= {(key, s, e) for s, e in merged}
    assert got == want
    points = [("hot", rng.randrange(0, 11 * 10**8), i) for i in range(200)]
    joined = join_points(
        spark.createDataFrame(points, "k string, at long, i int"), spark.createDataFrame(list(want), "k string, start_ms long, end_ms long"), ["k"], "at"
    )
    assert {r["i"] for r in joined.collect()} == {i for k, a, i in points if any(x == k and s <= a <= e for x, s, e in want)}


def test_coverage_contained_only_and_not_truncated(spark):
    cov = samples.coverage(
        spark.createDataFrame([("k", 0, 10, False), ("k", 10, 20, False), ("k", 30, 40, False), ("k", 20, 30, True)], "k string, start_ms long, end_ms long, truncated boolean"), ["k"]
    )
    asked = spark.createDataFrame([(1, "k", 5, 15), (2, "k", 15, 35), (3, "k", 30, 40), (4, "z", 1, 2)], "window_id int, k string, from_ms long, to_ms long")
    assert {r["window_id"]: r["covered"] for r in samples.is_covered(cov, asked, ["k"]).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_merge_keeps_the_held_event_and_the_newest(spark):
    schema = "channel string, source string, event_type string, event_id int, ts timestamp, v string"
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame([("c", "s", "t", i, t + dt.timedelta(minutes=i), "old") for i in range(3)], schema)
    new = spark.createDataFrame([("c", "s", "t", i, t + dt.timedelta(minutes=i), "new") for i in range(1, 5)], schema)
    assert {(r["event_id"], r["v"]) for r in samples.merge_sample(old, new, 3).collect()} == {(2, "old"), (3, "new"), (4, "new")}


def doc(payload, **more):
    env = {"type": "object", "properties": {"detail": {"$ref": "#/components/schemas/P"}}}
    return json.dumps({"openapi": "3.0.0", "components": {"schemas": {"AWSEvent": env, "P": {"type": "object", "properties": payload, **more}}}})


def test_version_diff_words_and_ledger(spark):
    v1 = doc({"a": {"type": "string", "minLength": 2}, "b": {"type": "integer"}, "c": {"type": "string"}})
    v2 = doc({"a": {"type": "string", "minLength": 3, "nullable": True}, "b": {"type": "number"}, "d": {"type": "string"}}, required=["b"])
    v3 = doc({"a": {"type": "string", "minLength": 3, "nullable": True}, "b": {"type": "number"}, "c": {"type": "string"}, "d": {"type": "string", "enum": ["x"]}})
    docs, _ = parse_contracts(spark.createDataFrame([("n", 9, v1), ("n", 10, v2), ("n", 11, v3)], "name string, version int, content string"))
    ledger = ver.change_ledger(ct.contract_fields(docs))
    rows = {(r["version"], r["path"]): (r["change"], r["detail"]) for r in ledger.collect()}
    assert rows[10, "a"] == ("changed", ["least characters was 2, is 3", "types was string, is string, null"])
    assert rows[10, "b"] == ("changed", ["required was false, is true", "types was integer, is number"])
    assert rows[10, "c"][0] == "removed" and rows[10, "d"][0] == "added" and rows[11, "c"][0] == "added"
    assert rows[11, "d"] == ("changed", ['values was not set, is "x"'])
    assert [r["path"] for r in ver.recurring_fields(ledger).collect()] == ["b", "c", "d"]


def test_lint(spark):
    bad = json.dumps(
        {
            "components": {
                "schemas": {
                    "AWSEvent": {"type": "object", "x-amazon-events-source": "Tide Tables", "x-amazon-events-detail-type": "a-b", "properties": {"detail": {"$ref": "#/components/schemas/P"}}},
                    "P": {
                        "type": "object",
                        "properties": {
                            "a": {"type": ["string", "null"]}, "b": {"type": "null"}, "c": {"type": "array", "items": [{}]}, "d": {"nullable": True},
                            "e": {"$ref": "#/components/schemas/Q", "minLength": 1}, "f": {"type": "integer", "format": "int64", "exclusiveMinimum": 3},
                            "g": {"const": 1}, "h": {"prefixItems": []}, "i": {"$schema": "https://json-schema.org/draft/2020-12/schema"},
                            "j": {"type": "string", "format": "ssn", "x-note": 1, "example": {"nullable": True}}, "k": {"exclusiveMaximum": True},
                            "l": {"anyOf": [{"type": "null"}, {"type": "string"}]},
                        },
                    },
                    "Q": {},
                }
            }
        }
    )
    docs, _ = parse_contracts(spark.createDataFrame([("Tide-Tables@a-b", 1, bad), ("x@y", 1, "{}")], "name string, version int, content string"))
    rows = {(r["name"], r["code"]): r for r in lint(docs).collect()}
    codes = {c for n, c in rows if n.startswith("Tide")}
    assert {
        "missing-openapi", "envelope-required", "envelope-properties", "identity-sanitized", "type-list", "type-null", "tuple-items", "untyped-nullable",
        "ref-siblings", "numeric-format", "numeric-exclusive", "boolean-exclusive", "not-openapi const", "post-draft-07 prefixItems", "foreign-dialect", "unknown-format",
    } <= codes
    assert "not-openapi $schema" not in codes and rows["Tide-Tables@a-b", "type-null"]["sites"] == 2
    assert rows["Tide-Tables@a-b", "untyped-nullable"]["shown"] == ["/components/schemas/P/properties/d"]
    assert {c for n, c in rows if n == "x@y"} == {"missing-openapi", "no-schemas"}


def test_contract_files_roundtrip(spark, tmp_path):
    for i, text in enumerate([json.dumps({"SchemaName": "a@b", "SchemaVersion": "3", "Content": doc({"x": {"type": "string"}})}), "{broken", json.dumps({"SchemaName": "c@d", "Content": json.loads(doc({}))})]):
        (tmp_path / f"{i}.json").write_text(text)
    good, bad = read_contracts(spark, str(tmp_path))
    assert {(r["name"], r["version"], r["source"]) for r in good.select("name", "version", "source").collect()} == {("a@b", 3, "a"), ("c@d", 1, "c")}
    assert bad.count() == 1
    out = str(tmp_path / "out")
    write_contracts(good.select("name", "version", "source", "event_type", "doc"), out, "parquet", relaxed=True)
    back = spark.read.parquet(out)
    assert back.where("content LIKE '%\"additionalProperties\":true%'").count() == 2


def test_readers_move_severity(spark):
    issues = spark.createDataFrame(
        [
            ("n", "wrongType", "matterId", True), ("n", "wrongType", "count", True), ("n", "neverSeen", "note", False), ("n", "wrongType", "meta.id", False),
            ("n", "wrongType", "items[].sku", False), ("n", "unregistered", "", False), ("m", "wrongType", "matterId", True),
        ],
        "name string, kind string, path string, rejects boolean",
    ).withColumns({"key": F.concat_ws(":", "kind", "path"), "severity": F.lit("warning")})
    reads = spark.createDataFrame([("n", "a.ts", "matterId.x"), ("n", "a.ts", "note"), ("n", "b.ts", "meta"), ("n", "b.ts", "items.sku")], "name string, file string, path string")
    rows = {(r["name"], r["path"]): (r["severity"], r["handlers"], r["readers"], r["indirect"]) for r in impact.grade_by_readers(issues, reads).collect()}
    assert rows["n", "matterId"] == ("error", 2, 1, 0) and rows["n", "count"] == ("warning", 2, 0, 0)
    assert rows["n", "note"] == ("warning", 2, 1, 0) and rows["n", "meta.id"] == ("warning", 2, 0, 1)
    assert rows["n", "items[].sku"][0] == "error" and rows["n", ""] == ("warning", None, None, None) and rows["m", "matterId"][0] == "error"


def test_code_reads(spark):
    code = (
        'const x = event.detail.a.b; // detail.no\n y = e?.detail?.["c"].d; z = detail.get("k").q; /* detail.never */ detail.items[0].sku; detail.list[i + 1];\n'
        "s = 'http://x//detail.inString'; evt['detail']['q-r']; payload.matterId; mydetail.nope; detail.names.length; detail.map(x => 1); # detail.py\n detail. prose"
    )
    files = spark.createDataFrame([("r", "src/a.ts", code, "svc", "consumer", False), ("r", "src/p.ts", code, "svc", "publisher", False)], "repo string, path string, content string, source string, role string, incidental boolean")
    got = {r["read"] for r in rd.code_reads(files).collect()}
    assert {"a.b", "c.d", "items[].sku", "list[]", "q-r", "payload.matterId", "names"} <= got, got
    assert not {g for g in got if g.startswith(("no", "never", "py", "map", "nope", "prose", "length", "inString"))}, got


def test_routing_prefers_the_specific_then_the_later_rule(spark):
    f = spark.createDataFrame([(s, o) for s in ("billing-invoices", "billing-x", "other") for o in (None, ["@team-a"])], "source string, owners array<string>")
    routes = spark.createDataFrame([(0, "billing*", "B", None), (1, "billing-invoices", "INV", "Task"), (2, "billing*", "B2", "")], "pos int, pattern string, project string, issue_type string")
    owners = spark.createDataFrame([(0, "@team-*", "T", "Bug")], "pos int, pattern string, project string, issue_type string")
    rows = {(r["source"], r["owners"] is not None): (r["project"], r["issue_type"]) for r in routing.route(f, routes, owners).collect()}
    assert rows == {
        ("billing-invoices", False): ("INV", "Task"), ("billing-invoices", True): ("INV", "Task"), ("billing-x", False): ("B2", "Bug"),
        ("billing-x", True): ("B2", "Bug"), ("other", False): (None, None), ("other", True): ("T", "Bug"),
    }


def test_topology(spark):
    declared = spark.createDataFrame([("a", "prd"), ("b", "prd"), ("c", "dev")], "bus string, stage string")
    live = spark.createDataFrame([("a",), ("c",), ("prd-x",), ("default",)], "bus string")
    assert {tuple(r) for r in topology.topology_drift(declared, live, "prd").collect()} == {("declared_only", "b"), ("live_only", "c")}


def test_log_lines(spark, tmp_path):
    (tmp_path / "app.log").write_text("[2026-07-31T20:15:00Z][INFO][ipc] list ok\n[t][NOPE][] x\nthread panicked\n[2026-07-31T20:16:00Z][ERROR][aws] bad\n")
    lines = applog.parse_log(spark.read.text(str(tmp_path)))
    rows = {r["raw"]: r for r in lines.collect()}
    ok = rows["[2026-07-31T20:15:00Z][INFO][ipc] list ok"]
    assert (ok["level"], ok["category"], ok["message"]) == ("info", "ipc", "list ok")
    assert (rows["[t][NOPE][] x"]["level"], rows["[t][NOPE][] x"]["category"]) == (None, None)
    assert rows["thread panicked"]["message"] == "thread panicked"
    assert applog.filter_log(lines, min_level="warn").count() == 1
    assert applog.filter_log(lines, categories=("(none)",)).count() == 2 and applog.filter_log(lines).count() == 4


def test_search_pages_do_not_overlap(make_events):
    events = make_events({"s@t": [{"n": i} for i in range(25)]})
    first = ev.search_events(events, F.lit(True), 10).orderBy(F.desc("ts")).collect()
    assert not first[0]["complete"] and first[0]["searched_from"] == first[-1]["ts"]
    second = ev.search_events(events, F.lit(True), 20, before=(first[-1]["ts"], first[-1]["event_id"])).collect()
    assert len(second) == 15 and second[0]["complete"] and not {r["event_id"] for r in first} & {r["event_id"] for r in second}


@pytest.mark.parametrize(
    ("old", "new", "said"),
    [
        ({"anyOf": [{"type": "string"}, {"type": "integer"}]}, {"anyOf": [{"type": "string"}]}, "alternatives was string, integer, is string"),
        ({"oneOf": [{"type": "string"}]}, {}, "exclusive alternatives was string, is not set"),
        ({"minProperties": 1}, {"minProperties": 5}, "least members was 1, is 5"), ({}, {"maxProperties": 2}, "most members was not set, is 2"),
        ({"allOf": [{}]}, {}, "ungraded keywords was allOf, is "), ({"enum": ["a"]}, {"enum": ["a", 1]}, 'values was "a", is "a", 1'),
        ({"const": 1}, {"const": 2}, "constant was 1, is 2"), ({"format": "date"}, {}, "format was date, is not set"),
        ({"additionalProperties": False}, {}, "closed was true, is false"), ({"uniqueItems": True}, {}, "unique items was true, is false"),
        ({"pattern": "a"}, {"pattern": "b"}, "pattern was a, is b"), ({"multipleOf": 2}, {}, "divisor was 2.0, is not set"),
        ({"exclusiveMinimum": 1}, {}, "exclusive minimum was 1.0, is not set"), ({"exclusiveMaximum": 1}, {}, "exclusive maximum was 1.0, is not set"),
        ({"maxLength": 1}, {}, "most characters was 1, is not set"), ({"minItems": 1}, {}, "least items was 1, is not set"),
        ({"maxItems": 1}, {}, "most items was 1, is not set"), ({"minimum": 1}, {}, "minimum was 1.0, is not set"), ({"maximum": 1}, {}, "maximum was 1.0, is not set"),
    ],
)
def test_every_keyword_of_a_field_is_compared(make_contracts, old, new, said):
    from pactline.operators.versions import contract_diff

    both = [ct.contract_fields(make_contracts({"n": {"Payload": {"type": "object", "properties": {"v": x}}}}), ("name",)) for x in (old, new)]
    assert [(r["change"], r["detail"]) for r in contract_diff(*both).collect()] == [("changed", [said])]
