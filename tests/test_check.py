"""Grading: one contract and its events per behaviour, all graded in one run."""

import json

import pytest
from pyspark.sql import functions as F

from pactline.operators.repairs import apply_repairs
from pactline.operators.issues import drift_rows, suggest_repairs
from pactline.plans.check import Check, event_issues

STRING = {"type": "string"}
SHIPMENT = {
    "Payload": {
        "type": "object",
        "required": ["shipperId"],
        "properties": {
            "shipperId": STRING,
            "status": {"type": "string", "enum": ["loaded", "sailed"]},
            "note": {"type": "string", "nullable": True},
            "count": {"type": "integer"},
            "cargo": {"$ref": "#/components/schemas/Cargo"},
            "berth": STRING,
        },
    },
    "Cargo": {"type": "object", "properties": {"sealNo": STRING}},
}


def obj(properties, **more):
    return {"Payload": {"type": "object", "properties": properties, **more}}


NULLABLE_CARGO = {
    "Payload": {"type": "object", "properties": {"cargo": {"type": "object", "nullable": True, "required": ["sealNo"], "properties": {"sealNo": STRING}}}}
}
CONTRACTS = {
    "a@base": SHIPMENT, "a@nullable": SHIPMENT, "a@null": SHIPMENT, "a@onecause": SHIPMENT, "a@undeclared": SHIPMENT, "a@underref": SHIPMENT,
    "a@never": SHIPMENT, "a@enum": SHIPMENT,
    "a@absent": obj({"id": STRING, "gone": STRING}, required=["gone"]),
    "a@carriers": NULLABLE_CARGO, "a@carriers2": NULLABLE_CARGO,
    "a@tworequired": obj({"a": STRING, "b": STRING}, required=["a", "b"]),
    "a@twoconstraints": obj({"ssn": {"type": "string", "minLength": 5, "pattern": "^[0-9]+$"}}),
    "a@shape": obj({"id": {"type": "string", "format": "uuid"}}),
    "a@cycle": {"Payload": {"type": "object", "properties": {"name": STRING, "child": {"$ref": "#/components/schemas/Payload"}}}},
    "a@closed": obj({"x": STRING}, additionalProperties=False),
    "a@blank": obj({"ssn": STRING}, required=["ssn"]),
    "a@numbers": obj({"n": {"type": "number"}, "i": {"type": "integer"}}),
    "a@bounds": obj({"n": {"type": "number", "minimum": 1, "maximum": 9, "multipleOf": 2}, "l": {"type": "array", "uniqueItems": True, "minItems": 1}}),
    "a@items": obj({"items": {"type": "array", "items": {"type": "object", "required": ["sku"], "properties": {"sku": STRING}}}}),
    "a@const": obj({"v": {"const": 1}}),
    "a@anyof": obj({"v": {"anyOf": [STRING]}}),
    "a@oneof": obj({"v": {"oneOf": [{"type": "integer"}, {"type": "number"}]}, "w": {"oneOf": [STRING, {"type": "integer"}]}}),
    "a@not": obj({"v": {"not": STRING}, "w": STRING}),
    "a@if": obj({"v": {"if": STRING}, "w": STRING}),
    "a@members": obj({"m": {"type": "object", "minProperties": 1, "maxProperties": 2}}),
    "a@dots": obj({"a.b": STRING, "a": {"type": "object", "properties": {"b": STRING}}}, required=["a.b", "c.d"], additionalProperties=False),
    "a@manyvalues": obj({"v": {"type": "string", "enum": ["x"]}}),
    "a@shared": {
        "Payload": {"type": "object", "properties": {"from": {"$ref": "#/components/schemas/Port"}, "to": {"$ref": "#/components/schemas/Port"}}},
        "Port": {"type": "object", "properties": {"code": {"type": "string", "enum": ["A"]}}},
    },
    "a@root": obj({"v": STRING}),
    "a@deep": obj({"a": {"type": "object", "properties": {"b": {"type": "object", "properties": {"c": {"type": "object", "properties": {"d": {"type": "object", "properties": {"e": {"type": "object", "properties": {"f": STRING}}}}}}}}}}}),
}
EVENTS = {
    "a@base": [{"shipperId": "a", "status": "sailed", "count": 1}, {"shipperId": "b", "status": "loaded"}],
    "a@nullable": [{"shipperId": "a", "note": None}],
    "a@null": [{"shipperId": None}],
    "a@onecause": [{"shipperId": 1}, {"shipperId": 2}, {"shipperId": 3}],
    "a@undeclared": [{"shipperId": "a", "draught": 1}, {"shipperId": "b", "draught": "x"}, {"shipperId": "c"}],
    "a@underref": [{"shipperId": "a", "cargo": {"sealNo": "t", "extra": 5}}],
    "a@never": [{"shipperId": "a"}],
    "a@enum": [{"shipperId": "a", "status": "held"}, {"shipperId": "b", "status": "adrift"}, {"shipperId": "c", "status": None}],
    "a@absent": [{"id": "1"}, {"id": "2"}],
    "a@carriers": [{"cargo": {"sealNo": "a"}}, {"cargo": {"sealNo": "b"}}, {}, {"cargo": None}],
    "a@carriers2": [{"cargo": {"sealNo": "a"}}, {"cargo": {}}],
    "a@tworequired": [{"b": "x"}, {"a": "x"}],
    "a@twoconstraints": [{"ssn": "xy"}],
    "a@shape": [{"id": "1677831-ff2a5b8e8c8aa859"}, {"id": "1677832-0f2a5b8e8c8aa85b"}, {"id": "1677833-aa2a5b8e8c8aa85c"}],
    "a@cycle": [{"name": "n"}, {"child": {"name": "m", "child": {"name": "o"}}}],
    "a@closed": [{"x": "1", "p": 1, "q": 2}, {"x": "2", "p": 1}],
    "a@blank": [{"ssn": ""}, {"ssn": " \t"}, {"ssn": "1"}],
    "a@numbers": ['{"n":1,"i":1}', '{"n":1.5,"i":1.0}', '{"n":18446744073709551615,"i":2}'],
    "a@bounds": [{"n": 0, "l": [1, 1]}, {"n": 11, "l": []}, {"n": 4, "l": [1, "1"]}],
    "a@items": [{"items": [{"sku": "a"}, {"qty": 1}, {"sku": 3}]}, {"items": [{"qty": 1}]}],
    "a@const": [{"v": 1}, {"v": 2}],
    "a@anyof": [{"v": 1}],
    "a@oneof": [{"v": 1, "w": 1}, {"w": True}, {"w": "s"}],
    "a@not": [{"v": 1}, {"w": "s"}, {"v": 1, "w": 2}],
    "a@if": [{"v": 1}, {"w": "s"}, {"v": 1, "w": 2}],
    "a@members": [{"m": {}}, {"m": {"x": 1}}, {"m": {"x": 1, "y": 2, "z": 3}}],
    "a@dots": [{"a.b": "s", "a": {"b": 1}}, {"a.b": 2, "c.d": 1}],
    "a@manyvalues": [{"v": f"v{i:02d}"} for i in range(40)],
    "a@shared": [{"from": {"code": "B"}, "to": {"code": "C"}}],
    "a@root": ["[1]", {"v": "x"}],
    "a@deep": [{"a": {"b": {"c": {"d": {"e": {"f": 1, "g": {"h": {"i": [[{"j": 1}]]}}}}}}}}],
    "a@loose": [{"z": 1}],
}


@pytest.fixture(scope="module")
def check(make_events, make_contracts):
    return Check(make_events(EVENTS), make_contracts(CONTRACTS))


@pytest.fixture(scope="module")
def issues(check):
    out = {}
    for r in check.ranked.collect():
        out.setdefault(r["name"], {})[r["key"]] = r
    return out


@pytest.fixture(scope="module")
def verdicts(check):
    return {r["name"]: (r["passed"], r["failed"]) for r in check.verdicts.collect()}


@pytest.fixture(scope="module")
def undecided(check):
    return {r["name"]: r["undecided"] for r in check.verdicts.collect()}


@pytest.fixture(scope="module")
def failures(check):
    out = {}
    for r in check.failures.collect():
        out.setdefault(r["name"], {})[(r["class"], r["path"], r["constraint"].rsplit("/", 1)[-1])] = r
    return out


def test_matching_events_pass(verdicts, issues):
    assert verdicts["a@base"] == (2, 0)
    assert all(r["severity"] == "info" for r in issues["a@base"].values())


def test_nullable_accepts_null_and_plain_string_does_not(verdicts):
    assert verdicts["a@nullable"] == (1, 0)
    assert verdicts["a@null"] == (0, 1)


def test_one_cause_is_one_group(failures):
    (only,) = failures["a@onecause"].values()
    assert (only["affected"], only["occurrences"], only["example"]) == (3, 3, "1")


def test_undeclared_counts_events_and_types(check, issues):
    row = issues["a@undeclared"]["undeclared:draught"]
    assert (row["affected"], row["severity"], row["observed"]) == (2, "warning", "integer | string")
    assert "undeclared:cargo.extra" in issues["a@underref"]


def test_never_seen_is_a_note(issues):
    keys = {k for k in issues["a@never"] if k.startswith("neverSeen")}
    assert {"neverSeen:berth", "neverSeen:cargo.sealNo"} <= keys
    assert issues["a@never"]["neverSeen:berth"]["severity"] == "info"


def test_enum_drift_lists_values_and_ignores_null(check, issues):
    row = issues["a@enum"]["outsideEnum:status"]
    # The validator also refuses the null, so three events are rejected.
    assert (row["affected"], row["rejects"]) == (3, True)
    drift = {r["name"]: r for r in check.drift["enum"].collect()}["a@enum"]
    assert (drift["unexpected"], drift["unexpected_in"]) == (['"adrift"', '"held"'], 2)


def test_required_and_never_sent_is_missing_not_unseen(issues):
    assert issues["a@absent"]["missingRequired:gone"]["affected"] == 2
    assert "neverSeen:gone" not in issues["a@absent"]


def test_required_is_measured_against_carriers(issues, verdicts):
    assert "missingRequired:cargo.sealNo" not in issues.get("a@carriers", {})
    assert verdicts["a@carriers"] == (4, 0)
    assert issues["a@carriers2"]["missingRequired:cargo.sealNo"]["affected"] == 1


def test_two_required_fields_stay_apart(issues):
    for key in ("missingRequired:a", "missingRequired:b"):
        row = issues["a@tworequired"][key]
        assert (row["affected"], row["rejects"]) == (1, True)
        assert "50%" in row["summary"]


def test_two_constraints_are_two_issues(issues):
    keys = [k for k in issues["a@twoconstraints"] if k.startswith("rejected")]
    assert keys and {k.rsplit("/", 1)[1] for k in keys} == {"minLength", "pattern"}


def test_cycle_ends_and_declares_the_cyclic_field(issues, verdicts, undecided):
    # Below the cycle nothing is graded.
    assert verdicts["a@cycle"] == (1, 0) and undecided["a@cycle"] == 1
    assert "undeclared:child" not in issues["a@cycle"]
    assert "undeclared:child.child" in issues["a@cycle"]


def test_closed_object_explains_each_field_and_fails_each_event_once(issues, verdicts):
    assert verdicts["a@closed"] == (0, 2)
    assert issues["a@closed"]["undeclared:p"]["affected"] == 2
    assert issues["a@closed"]["undeclared:q"]["severity"] == "error"


def test_blank_required(issues, verdicts):
    row = issues["a@blank"]["emptyRequired:ssn"]
    assert (row["affected"], row["rejects"], verdicts["a@blank"]) == (2, False, (3, 0))


def test_integer_is_a_number_and_whole_number_is_valid_but_drifts(issues, verdicts):
    assert verdicts["a@numbers"] == (3, 0)
    assert "wrongType:n" not in issues.get("a@numbers", {})
    assert issues["a@numbers"]["wrongType:i"]["affected"] == 1


def test_bounds(failures):
    seen = {k[2] for k in failures["a@bounds"]}
    assert seen == {"minimum", "maximum", "multipleOf", "uniqueItems", "minItems"}


def test_array_elements_collapse_to_one_path(issues, failures):
    assert failures["a@items"][("missingRequired", "items[].sku", "missingRequired")]["affected"] == 2
    assert failures["a@items"][("wrongType", "items[].sku", "wrongType")]["affected"] == 1
    assert issues["a@items"]["undeclared:items[].qty"]["affected"] == 2


def test_const_and_root_type(failures):
    assert failures["a@const"][("outsideEnum", "v", "outsideEnum")]["affected"] == 1
    assert ("wrongType", "", "wrongType") in failures["a@root"]


def test_ungradable_is_reported(check):
    rows = {r["name"]: r["ungraded"] for r in check.ungradable.collect()}
    assert rows == {"a@cycle": 1, "a@if": 1}


def test_alternatives_of_types_and_member_counts(failures, verdicts):
    assert failures["a@anyof"][("other", "v", "anyOf")]["affected"] == 1
    assert failures["a@oneof"][("other", "w", "oneOf")]["affected"] == 1
    assert {k[2]: r["affected"] for k, r in failures["a@members"].items()} == {"minProperties": 1, "maxProperties": 1}
    assert verdicts["a@members"] == (1, 2)


def test_ungraded_values_leave_an_event_undecided(verdicts, undecided):
    # One event holds the value and breaks nothing, one lacks it, one is broken elsewhere.
    assert verdicts["a@if"] == (1, 1) and undecided["a@if"] == 1
    assert verdicts["a@not"] == (2, 1) and undecided["a@not"] == 0
    assert verdicts["a@oneof"] == (1, 2) and undecided["a@oneof"] == 0
    assert undecided["a@base"] == 0


def test_dots_in_member_names_are_no_steps(check, issues):
    assert {"wrongType:a.b", "wrongType:a%2Eb", "rejected:c%2Ed:missingRequired", "undeclared:c%2Ed"} <= set(issues["a@dots"])
    seen = {r["path"]: r["seen_in"] for r in check.profile.where("name = 'a@dots'").collect()}
    assert seen == {"": 2, "a": 1, "a.b": 1, "a%2Eb": 2, "c%2Ed": 1}


def test_enum_repair_takes_every_value_and_joins_paths_of_a_shared_type(check):
    names = ["a@manyvalues", "a@shared"]
    asked = check.issues.where(F.col("name").isin(*names)).select("name", "path", "fix")
    edited, refused = apply_repairs(check.fields, asked, enum_values=check.enum_values)
    allowed = {(r["name"], r["path"]): r["enum_json"] for r in edited.where("enum_json IS NOT NULL").collect()}
    assert len(allowed["a@manyvalues", "v"]) == 41
    assert allowed["a@shared", "from.code"] == allowed["a@shared", "to.code"] == ['"A"', '"B"', '"C"']
    assert refused.count() == 0
    again = Check(check.events, check.contracts, names)
    again.__dict__["fields"] = again.__dict__["rules"] = edited
    assert again.issues.where("kind = 'outsideEnum'").count() == 0


def test_nesting_beyond_the_unrolled_levels(issues):
    deep = issues["a@deep"]
    assert "wrongType:a.b.c.d.e.f" in deep
    assert "undeclared:a.b.c.d.e.g.h.i[][].j" in deep


def test_unregistered(check):
    (row,) = check.unregistered.collect()
    assert (row["name"], row["affected"], row["observed"]) == ("a@loose", 1, "1 event on the bus")


def test_keys_found_on_the_sample_are_found_on_single_events(check, issues):
    each = event_issues(check.graded, check.rules, check.clauses)
    single = {(r["name"], r["key"]) for r in each.select("name", "key").distinct().collect()}
    sample = {(n, k) for n, rows in issues.items() for k, r in rows.items() if r["kind"] != "neverSeen"}
    missing = {x for x in sample if x not in single and x != ("a@items", "missingRequired:items[].sku")}
    assert not missing


def test_shape_repair_and_repairs_clear_their_issues(check, make_events, issues):
    fixed = suggest_repairs(check.issues, check.occurrences)
    row = fixed.where("name = 'a@shape' AND kind = 'rejected'").first()
    assert row["fix"]["pattern"] == r"^\d{7}-[0-9a-f]{16}$"
    names = ["a@onecause", "a@undeclared", "a@enum", "a@tworequired", "a@blank", "a@shape", "a@underref"]
    asked = fixed.where(F.col("name").isin(*names)).select("name", "path", "fix")
    edited, _ = apply_repairs(check.fields, asked)
    again = Check(check.events, check.contracts, names)
    again.__dict__["fields"] = again.__dict__["rules"] = edited
    left = {
        (r["name"], r["key"]) for r in again.issues.collect()
        if r["kind"] not in ("neverSeen", "outsideEnum") and r["name"] != "a@blank" and r["key"] != "undeclared:draught"
        # The null outside the enum is no observed value to allow.
        and r["key"] != "rejected:status:outsideEnum"
    }
    # A mixed field gets both types; what is left are none of the repaired kinds.
    assert left == set(), left
    blank = again.verdicts.where("name = 'a@blank'").first()
    assert blank["failed"] == 1


def test_refused_repairs(check, spark):
    fix = "struct<kind:string,types:array<string>,values:array<string>,pattern:string>"
    asked = spark.createDataFrame(
        [("a@base", "items[]", ("dropRequired", None, None, None)), ("a@base", "note", ("dropRequired", None, None, None)),
         ("a@base", "nope", ("widenType", ["string"], None, None)), ("a@base", "x.y", ("declareField", ["string"], None, None)),
         ("a@base", "note", ("declareField", ["string"], None, None)),
         ("a@base", "cargo", ("widenType", ["object", "null"], None, None))],
        f"name string, path string, fix {fix}",
    )
    _, refused = apply_repairs(check.fields, asked)
    reasons = {(r["path"], r["kind"]): r["reason"] for r in refused.collect()}
    assert reasons == {
        ("items[]", "dropRequired"): "not a named property", ("note", "dropRequired"): "already optional",
        ("nope", "widenType"): "not declared", ("x.y", "declareField"): "no type owns this path",
        ("note", "declareField"): "already declared", ("cargo", "widenType"): "declared by a reference",
    }


def test_drift_rows_and_json_roundtrip(check):
    assert drift_rows(check.drift).where("kind = 'wrongType' AND name = 'a@onecause'").count() == 1
    assert json.loads(check.contracts.select(F.to_json("doc")).first()[0])["openapi"] == "3.0.0"
