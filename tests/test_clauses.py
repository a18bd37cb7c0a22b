"""Composition, wildcards and nested arrays, against a small reading of the same keywords."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pactline.operators.clauses import contract_clauses
from pactline.plans.check import Check, event_issues

STRING, INT = {"type": "string"}, {"type": "integer"}
KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", type(None): "null"}


def holds(schema, value, types):
    """Whether a value meets a schema, for the keywords the tests use."""
    if schema is True or schema is False:
        return schema
    if "$ref" in schema:
        schema = types[schema["$ref"].rsplit("/", 1)[1]]
    kind = KINDS[type(value)]
    wanted = schema.get("type")
    if wanted is not None and kind != wanted and not (kind == "integer" and wanted == "number") and not (schema.get("nullable") and value is None):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if kind == "string" and not len(value) >= schema.get("minLength", 0):
        return False
    if kind == "integer" and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return False
    if kind == "array" and not all(holds(schema.get("items", {}), v, types) for v in value):
        return False
    if kind == "object":
        named, rest = schema.get("properties", {}), schema.get("additionalProperties", {})
        if not set(schema.get("required", [])) <= set(value) or len(value) < schema.get("minProperties", 0):
            return False
        if not all(holds(named[k] if k in named else rest, v, types) for k, v in value.items()):
            return False
    fits = {k: [holds(b, value, types) for b in schema[k]] for k in ("allOf", "anyOf", "oneOf") if k in schema}
    return (
        all(fits.get("allOf", [])) and any(fits.get("anyOf", [True])) and sum(fits.get("oneOf", [True])) == 1
        and not ("not" in schema and holds(schema["not"], value, types))
    )


def a_schema(rng, depth):
    kinds = ["string", "integer", "enum", "any"] if depth == 0 else ["object", "object", "map", "array", "allOf", "anyOf", "oneOf", "not", "string", "integer", "ref"]
    kind = rng.choice(kinds)
    if kind == "string":
        return {"type": "string", "minLength": rng.randint(0, 2)}
    if kind == "integer":
        return {"type": "integer", "minimum": rng.randint(0, 3), "maximum": rng.randint(2, 6)}
    if kind == "enum":
        return {"enum": rng.sample(["a", "bb", 1, 2, None], 3)}
    if kind == "any":
        return rng.choice([{}, {"type": "object"}, {"type": "null"}])
    if kind == "ref":
        return {"$ref": f"#/components/schemas/{rng.choice(['List', 'Leaf'])}"}
    if kind == "array":
        return {"type": "array", "items": a_schema(rng, depth - 1)}
    if kind == "not":
        return {"not": a_schema(rng, depth - 1)}
    if kind in ("allOf", "anyOf", "oneOf"):
        found = {kind: [a_schema(rng, depth - 1) for _ in range(rng.randint(1, 3))]}
        return found | ({"minProperties": 1} if rng.random() < 0.2 else {})
    found = {"properties": {k: a_schema(rng, depth - 1) for k in rng.sample("abc", rng.randint(0, 2))}}
    if rng.random() < 0.7:
        found["type"] = "object"
    if rng.random() < 0.3:
        found["required"] = rng.sample("abc", 1)
    if kind == "map" or rng.random() < 0.15:
        found["additionalProperties"] = rng.choice([False, a_schema(rng, depth - 1)])
    return found


def a_value(rng, depth):
    kind = rng.choice(["s", "i", "i", "n"] if depth == 0 else ["o", "o", "o", "l", "s", "i"])
    if kind == "o":
        return {k: a_value(rng, depth - 1) for k in rng.sample(["a", "b", "c", "x.y", "*"], rng.randint(0, 3))}
    if kind == "l":
        return [a_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {"s": rng.choice(["", "a", "bb"]), "i": rng.randint(0, 6), "n": None}[kind]


SHARED = {"List": {"type": "array", "items": {"type": "array", "items": INT}}, "Leaf": {"type": "object", "properties": {"a": STRING}, "additionalProperties": INT}}


def test_random_contracts_equal_a_plain_reading(make_events, make_contracts):
    rng = random.Random(1)
    types, payloads = {}, {}
    for i in range(30):
        schema = a_schema(rng, 4)
        schema = schema if rng.random() < 0.5 else {"type": "object", "properties": {k: a_schema(rng, 3) for k in "abc"}}
        types[f"r@c{i}"] = {"Payload": schema, **SHARED}
        payloads[f"r@c{i}"] = [{k: a_value(rng, 3) for k in rng.sample("abc", rng.randint(0, 3))} for _ in range(25)]
    want, n = {}, 0
    for name, values in payloads.items():
        for value in values:
            if not holds(types[name]["Payload"], value, types[name]):
                want.setdefault(name, set()).add(n)
            n += 1
    check = Check(make_events(payloads), make_contracts(types))
    ungraded = {r["name"] for r in check.ungradable.collect()}
    assert not ungraded
    found, each = {}, {}
    for name, event in check.violations.select("name", "event_id").distinct().collect():
        found.setdefault(name, set()).add(event)
    for r in event_issues(check.graded, check.rules, check.clauses).where("rejects").select("name", "event_id").distinct().collect():
        each.setdefault(r["name"], set()).add(r["event_id"])
    flat = [v for values in payloads.values() for v in values]
    for name in types:
        odd = found.get(name, set()) ^ want.get(name, set())
        assert not odd, (name, json.dumps(types[name]["Payload"]), [json.dumps(flat[k]) for k in sorted(odd)[:3]])
    assert found == want and each == want and sum(map(len, want.values())) > 150
    failed = {r["name"]: r["failed"] for r in check.verdicts.collect()}
    assert all(failed[name] == len(want.get(name, ())) for name in failed)


def obj(properties, **more):
    return {"type": "object", "properties": properties, **more}


CONTRACTS = {
    "m@map": {"Payload": obj({"legs": obj({"total": INT}, additionalProperties=obj({"port": STRING}, required=["port"]))})},
    "m@grid": {"Payload": obj({"grid": {"type": "array", "items": {"type": "array", "items": INT}}})},
    "m@one": {"Payload": obj({"party": {"oneOf": [obj({"id": STRING}, required=["id"]), obj({"name": STRING}, required=["name"])]}})},
    "m@if": {"Payload": obj({"v": {"anyOf": [{"if": STRING}, obj({"a": INT})]}, "w": {"not": STRING}})},
    "m@tree": {"Payload": obj({"left": {"anyOf": [{"type": "null"}, {"$ref": "#/components/schemas/Payload"}]}})},
    "m@plain": {"Payload": obj({"a": STRING})},
}
EVENTS = {
    "m@map": [{"legs": {"total": 1, "l-1": {"port": "x"}, "l-2": {"port": 2}, "l-3": {}}}, {"legs": {f"l-{i}": {"port": "x", "extra": i} for i in range(300)}}, {"legs": {"total": "t"}}],
    "m@grid": [{"grid": [[1, 2], ["x", 3, "y"]]}, {"grid": [[1]]}, {"grid": [1]}],
    "m@one": [{"party": {"id": "1"}}, {"party": {"id": "1", "name": "n"}}, {"party": {}}, {"party": [1]}, {}],
    "m@if": [{"v": 1}, {"w": 1}, {"w": "s"}, {"v": 1, "w": "s"}],
    "m@tree": [{"left": None}, {"left": {"left": {"left": 1}}}],
    "m@plain": [{"a": "x"}],
}


@pytest.fixture(scope="module")
def check(make_events, make_contracts):
    return Check(make_events(EVENTS), make_contracts(CONTRACTS))


def test_members_of_a_map_share_one_path(check):
    paths = {r["path"]: (r["seen_in"], r["types"]) for r in check.profile.where("name = 'm@map'").collect()}
    assert paths == {
        "": (3, ["object"]), "legs": (3, ["object"]), "legs.total": (2, ["integer", "string"]), "legs.*": (2, ["object"]),
        "legs.*.port": (2, ["integer", "string"]), "legs.*.extra": (1, ["integer"]),
    }
    keys = {r["key"]: r["affected"] for r in check.issues.where("name = 'm@map'").collect()}
    assert keys == {
        "wrongType:legs.total": 1, "wrongType:legs.*.port": 1, "undeclared:legs.*.extra": 1,
        "rejected:legs.*.port:missingRequired": 1,
    }


def test_pointers_lead_to_the_clause(check):
    found = {(r["name"], r["path"], r["constraint"]): r["affected"] for r in check.failures.where("class = 'other'").collect()}
    assert found == {("m@one", "party", "/properties/party/oneOf"): 3, ("m@if", "w", "/properties/w/not"): 2}


def test_arrays_of_arrays(check):
    found = {(r["path"], r["class"]): (r["affected"], r["occurrences"]) for r in check.failures.where("name = 'm@grid'").collect()}
    assert found == {("grid[][]", "wrongType"): (1, 2), ("grid[]", "wrongType"): (1, 1)}
    assert check.issues.where("name = 'm@grid' AND kind = 'undeclared'").count() == 0


def test_verdicts_and_what_stays_undecided(check):
    rows = {r["name"]: (r["passed"], r["failed"], r["undecided"]) for r in check.verdicts.collect()}
    assert rows == {
        "m@map": (1, 2, 0), "m@grid": (1, 2, 0), "m@one": (2, 3, 0), "m@if": (1, 2, 1), "m@tree": (0, 0, 2), "m@plain": (1, 0, 0),
    }
    assert {r["name"]: r["ungraded"] for r in check.ungradable.collect()} == {"m@if": 1, "m@tree": 1}


def test_one_form_for_sample_and_single_events(check):
    each = event_issues(check.graded, check.rules, check.clauses)
    single = {(r["name"], r["key"]) for r in each.select("name", "key").distinct().collect()}
    sample = {(r["name"], r["key"]) for r in check.issues.where("kind <> 'neverSeen'").collect()}
    assert sample <= single


def test_plain_contracts_have_no_clauses(make_contracts):
    assert contract_clauses(make_contracts({"m@plain": CONTRACTS["m@plain"]})) is None


def test_nested_arrays_behind_a_reference(make_events, make_contracts):
    types = {"Payload": obj({"l": {"$ref": "#/components/schemas/List"}}), **SHARED}
    check = Check(make_events({"r@l": [{"l": [["x"]]}, {"l": [[1]]}]}), make_contracts({"r@l": types}))
    assert [r["event_id"] for r in check.violations.where(F.col("path") == "l[][]").collect()] == [0]
