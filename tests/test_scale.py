"""Steps whose work must grow with their input: same results as comparing all pairs, and no row that multiplies."""

import random

import pytest
from pyspark.sql import functions as F

from pactline.operators import samples
from pactline.operators import watch as wa
from pactline.operators.intervals import count_inside, reach_at
from pactline.sources import applog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_looked_for_in_the_column_named(spark):
    lines = applog.parse_log(spark.createDataFrame([("[7][ERROR][view] ok",), ("[1][ERROR][view] k7",)], "value string"))
    assert [r["message"] for r in applog.filter_log(lines, text="7", text_col="message").collect()] == ["k7"]
    assert applog.filter_log(lines, text="7").count() == 2


def test_log_filter_asks_for_every_seven(spark, tmp_path):
    from workload.queries_context import QUERIES

    # Event 6 is an error, 1 a warning; both of category view.
    rows = [(6, 1, "view", '{"k": 17}'), (1, 1, "view", '{"k": 7}'), (13, 1, "view", '{"k": 8}')]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    df.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r["event_id"] for r in QUERIES["log_filter"](spark, str(tmp_path)).collect()) == [1, 6]


def test_rules_that_share_an_extension_meet_few_texts(spark):
    from pactline.operators.glob_join import rule_key

    rules = [f"*{k}.yml" for k in range(100, 160)] + [f"*f{k}*" for k in range(100, 160)] + [f"f{k}*" for k in range(100, 160)]
    keyed = rule_key(spark.createDataFrame([(r,) for r in rules], "pattern string"), "pattern", True)
    assert keyed.groupBy("_key").count().agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize("over_paths", [True, False])
def test_starts_ends_and_insides_of_words_meet(spark, over_paths):
    from pactline.functions.globs import glob_regex_col, path_glob_regex_col
    from pactline.operators.glob_join import join_globs

    long = "x" * 40
    patterns = ["f1*", "*1.ts", "*f1*", "a*b", f"{long}*", f"*{long}", f"*{long}y*", "a**b", "*a*/b", "f1*", "f*1", "**/b.ts", "é*"]
    texts = ["f1", "f12", "f12/b.ts", "xf1x/c", "q1.ts", "q1.tsx", "axb", "a/b", "xa1/b", long, long + "yz", "z" + long, "z" + long + "yz/q", "éa", "fé1", None]
    rules = spark.createDataFrame([*enumerate(patterns), (99, None)], "no int, pattern string")
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = sorted((r["text"], r["no"]) for r in join_globs(df, "text", rules, over_paths=over_paths).collect())
    rx = path_glob_regex_col(F.col("pattern")) if over_paths else glob_regex_col(F.col("pattern"))
    want = df.crossJoin(rules.withColumn("rx", rx)).where(F.rlike("text", F.col("rx")))
    assert got == sorted((r["text"], r["no"]) for r in want.collect()) and got


def test_points_inside_spans_against_brute_force(spark):
    rng = random.Random(5)
    keys = ["a", "b", None]
    spans = [(rng.choice(keys), f"m{i % 70}", s, None if i % 9 == 0 else s + rng.choice([0, 1, 40, 900, -5])) for i, s in enumerate(rng.choices(range(1000), k=90))]
    points = [(rng.choice(keys), rng.choice([rng.randrange(1000), None, 5, 6]), rng.randint(1, 3)) for _ in range(200)]
    got = {
        (r["k"], r["id"]): r["n"]
        for r in count_inside(
            spark.createDataFrame(spans, "k string, id string, start_ms long, end_ms long"), spark.createDataFrame(points, "k string, at long, n long"),
            ["k"], ["id"], "at", bucket_ms=37,
        ).collect()
    }
    want = {}
    for k, i, s, e in spans:
        if k is not None and (e is None or e >= s):
            want[k, i] = want.get((k, i), 0) + sum(n for q, at, n in points if q == k and at is not None and s <= at and (e is None or at <= e))
    assert got == want and max(want.values()) > 20


def test_reach_of_intervals_against_brute_force(spark):
    rng = random.Random(6)
    spans = [(rng.choice(["a", "b", None]), s, s + rng.choice([0, 3, 90, 700])) for s in rng.choices(range(1000), k=60)]
    points = [(i, rng.choice(["a", "b", "c", None]), rng.choice([rng.randrange(1000), None])) for i in range(200)]
    found = reach_at(
        spark.createDataFrame(points, "i int, k string, at long"), spark.createDataFrame(spans, "k string, start_ms long, end_ms long"), ["k"], "at", bucket_ms=41
    )
    got = {r["i"]: r["reach"] for r in found.collect()}
    want = {i: max((e for q, s, e in spans if q == k and s <= at), default=None) for i, k, at in points if k is not None and at is not None}
    assert got == want


def test_long_islands_and_long_sessions_are_not_listed_day_by_day(spark):
    cov = spark.createDataFrame([("k", 0, 10**13)], "k string, start_ms long, end_ms long")
    asked = spark.createDataFrame([(1, "k", 5, 10**12), (2, "k", 5, 10**14)], "window_id int, k string, from_ms long, to_ms long")
    held = samples.is_covered(cov, asked, ["k"])
    assert {r["window_id"]: r["covered"] for r in held.collect()} == {1: True, 2: False}
    hits = spark.createDataFrame([("e", 50), ("e", 10**12), ("x", 1)], "env string, at long")
    marks = spark.createDataFrame([("e", "m1", "start", 50), ("e", "m2", "stop", 10**12), ("e", "m3", "start", 10**12)], "env string, mark_id string, kind string, at long")
    sessions = wa.watch_sessions(hits, marks)
    assert {(r["mark_id"], r["hits"], r["watched_ms"]) for r in sessions.collect()} == {("m1", 2, 10**12 - 50), ("m3", 1, None)}
    kept = wa.surviving_marks(marks, hits)
    assert {r["mark_id"] for r in kept.collect()} == {"m1", "m2", "m3"}
    for df in (held, sessions, kept):
        assert "sequence(" not in plan(df)


def test_depth_of_brackets_outside_strings(spark):
    from pactline.operators.observe import _depth_sql

    texts = ['{}', '[]', '[{"m":1}]', '{"a]":"}]}","b":[[1,"\\"}"]]}', '["\\\\",[[[]]]]', '["\\\\\\"]",[1]]', '["' + 'x[' * 20000 + '"]']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").selectExpr(_depth_sql("t")).collect()]
    assert got == [1, 1, 2, 3, 4, 2, 1]


def test_wide_and_deep_payloads_are_walked_to_the_end(spark, make_events):
    from pactline.operators.observe import event_paths

    wide = {"rows": [{f"m{i % 700}": i, "s": "]}\\\""} for i in range(3000)]}
    deep = {"a": [[[[[[{"b}": [{"c": [1]}]}]]]]]]}
    found = event_paths(make_events({"s@wide": [wide], "s@deep": [deep]})).collect()
    paths = {r["event_type"]: {x["path"] for x in found if x["event_type"] == r["event_type"]} for r in found}
    assert {f"rows[].m{i}" for i in range(700)} | {"rows[].s", "rows[]", "rows", ""} == paths["wide"]
    assert "a[][][][][][].b}[].c[]" in paths["deep"]


def test_types_of_containers_need_no_schema_of_their_elements(spark):
    from pactline.functions.json_types import type_sql

    texts = ["{}", "[]", '{"a":[1]}', "null", "1", "1.5", '"x"', "true", "18446744073709551615"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").selectExpr("i", "parse_json(t) AS v").orderBy("i")
    got = [r[0] for r in df.selectExpr(type_sql("v")).collect()]
    assert got == ["object", "array", "object", "null", "integer", "number", "string", "boolean", "integer"]


def test_examples_without_the_sketch_are_not_sorted(spark):
    from pactline.operators.observe import field_examples

    rows = [("n", "p", "string", '"b"', 2, 1), ("n", "p", "string", '"a"', 1, 5), ("n", "p", "string", '"c"', 1, 5)]
    obs = spark.createDataFrame(rows, "name string, path string, type string, value_json string, ts long, event_id long")
    found = field_examples(obs, ["name"]).drop("approx_values")
    assert [r["example"] for r in found.collect()] == ['"a"'] and "SortAggregate" not in plan(found)


def test_events_of_one_row_group_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    from workload import bus

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(bus, "ROWS_A_TASK", 50)
    dealt = bus.spread_rows(bus.table(spark, str(tmp_path), "events"))
    assert dealt.rdd.getNumPartitions() == 20 and dealt.count() == 1000


def test_checks_read_the_text_of_a_value_once(make_events, make_contracts):
    from pactline.operators import violations as v
    from pactline.plans.check import Check

    schema = {"type": "object", "required": ["a"], "minProperties": 1, "properties": {"a": {"type": "string", "minLength": 2, "maxLength": 3}}}
    c = Check(make_events({"s@t": [{"a": "x"}, {"a": "xx"}, {"b": 1}, {}]}), make_contracts({"s@t": {"Payload": schema}}))
    # Whatever a check reads of the JSON text is a column before the checks, which are interpreted.
    checks = " ".join(map(str, v.value_checks()))
    assert "minProperties" in checks
    assert not [f for f in ("json_object_keys", "json_array_length", "get_json_object") if f in checks]
    got = {(r["event_id"], r["constraint"]) for r in c.violations.collect()}
    assert got == {
        (0, "/properties/a/minLength"), (2, "missingRequired"), (3, "missingRequired"), (3, "/minProperties"),
    }


def test_documents_are_compared_by_what_is_small(spark):
    from pactline.operators.versions import reconcile

    rows = [("a", '{"x": 1, "y": [2]}'), ("b", '{"x": 1}'), ("c", '{"x": 1}'), ("d", None), ("e", "null"), (None, "1")]
    candidate = spark.createDataFrame(rows, "name string, text string").select("name", F.parse_json("text").alias("doc"))
    rows = [("a", '{"y":[2],"x":1}'), ("b", '{"x": 2}'), ("d", "1"), ("e", "null"), ("f", "1"), (None, "1")]
    live = spark.createDataFrame(rows, "name string, text string").select("name", F.parse_json("text").alias("doc"))
    found = reconcile(candidate, live)
    got = {(r["name"], r["action"]) for r in found.collect()}
    assert got == {("a", "unchanged"), ("b", "update"), ("c", "create"), ("d", "error"), ("e", "unchanged"), (None, "create")}
    # Above the join nothing reads a document.
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "doc" not in above


def test_a_document_is_parsed_once_whatever_asks_for_it(spark, make_contracts):
    from pactline.operators import contracts as ct

    docs = make_contracts({"n": {"Payload": {"type": "object", "properties": {"v": {"type": "string"}}}}})
    # Once, and the content of a JSON string once more; filters on the document must not hold a parse of their own.
    assert plan(docs).count("parseJson") == 2
    walk = ct._expand(docs, ["name"], 1)
    assert plan(walk).count("parseJson") == 2
    # Two reads of a node below a level: what the walk needs of it, and the reference of a member.
    assert plan(ct._expand(docs, ["name"], 2)).count("try_variant_get") - plan(walk).count("try_variant_get") == 2


def test_members_of_a_schema_are_read_by_kind(make_contracts):
    from pactline.operators import contracts as ct

    props = {
        "a": {"type": ["string", 3], "nullable": "true", "minLength": "x", "enum": "e", "const": None, "items": [{"items": {}}]},
        "b": {"exclusiveMinimum": True, "exclusiveMaximum": 2, "additionalProperties": "false", "not": None, "format": "regex"},
        "c": {"properties": {}, "required": "a", "additionalProperties": False, "anyOf": 1, "oneOf": [{"type": "null"}]},
        "d": True,
    }
    rows = ct.contract_fields(make_contracts({"n": {"Payload": {"properties": props}}}), ("name",)).where("depth = 1")
    a, b, c, d = rows.orderBy("path").collect()
    assert (a["types"], a["typed"], a["nullable"], a["min_len"], a["enum_json"], a["const_json"]) == (["string", "3", "null"], True, True, None, None, "null")
    assert (b["types"], b["above"], b["below"], b["closed"], b["ungradable"]) == ([], None, 2.0, False, ["not", "format regex"])
    assert (c["types"], c["closed"], c["required_names"], c["any_of"], c["one_of"]) == (["object"], True, [], None, ["null"])
    assert (c["ungradable"], d["types"], d["typed"], d["declared_names"]) == (["anyOf"], [], False, [])
