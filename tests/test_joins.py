"""Joins that avoid comparing all pairs, against comparing them."""

import random

import pytest
from pyspark.sql import functions as F

from pactline.functions.globs import glob_regex_col, path_glob_regex_col
from pactline.operators.containment import contained_in
from pactline.operators.glob_join import join_globs
from pactline.operators.intervals import union_intervals
from pactline.operators.issues import group_siblings
from pactline.operators.readers import apply_ignores, owners_for
from pactline.operators.routing import match_tickets, route


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("over_paths", "ignore_case"), [(True, False), (False, False), (False, True)])
def test_globs_meet_as_regular_expressions_do(spark, over_paths, ignore_case):
    rng = random.Random(1)
    parts = ["src", "app", "f1", "f12", "a.ts", "b_c", "Ünï", "x-y", "", "é", "SRC", "[1]"]
    texts = {"/".join(rng.choices(parts, k=rng.randint(1, 4))).strip("/") for _ in range(250)} | {"", "a", "ab", "abc", "a\u0001b"}
    bits = ["*", "**", "/", "src", "f1", "a", ".ts", "b_", "[1]", "ï", "y", "App", "*/", "12"]
    rules = {"".join(rng.choices(bits, k=rng.randint(1, 5))) for _ in range(400)} | {"*", "**", "a", "", "*f1*", "/src/**/f12"}
    if over_paths:
        rules = {r for r in rules if r.strip("/")}
    texts = spark.createDataFrame([(t,) for t in sorted(texts)], "text string")
    table = spark.createDataFrame(list(enumerate(sorted(rules))), "pos int, pattern string")
    got = join_globs(texts, "text", table, over_paths=over_paths, ignore_case=ignore_case)
    rx = path_glob_regex_col(F.col("pattern")) if over_paths else glob_regex_col(F.col("pattern"), ignore_case)
    want = texts.crossJoin(table.withColumn("rx", rx)).where(F.rlike("text", F.col("rx")))
    found = sorted((r["text"], r["pos"]) for r in got.collect())
    assert found == sorted((r["text"], r["pos"]) for r in want.collect()) and len(found) > 1000


def test_containment(spark):
    rng = random.Random(2)
    sets = [(i, rng.sample("abcdefgh", rng.randint(0, 3)) + (["a"] if i % 5 == 0 else [])) for i in range(120)] + [(120, ["nobody", "a"])]
    holders = [(i, rng.choices("aaaaabcdefgh", k=rng.randint(0, 6))) for i in range(150)]
    got = contained_in(
        spark.createDataFrame(sets, "s int, members array<string>"), "members", spark.createDataFrame(holders, "h int, held array<string>"), "held"
    )
    want = sorted((s, h) for s, a in sets for h, b in holders if a and set(a) <= set(b))
    assert sorted((r["s"], r["h"]) for r in got.collect()) == want


def test_no_nested_loops(spark):
    files = spark.createDataFrame([("r", "src/a.ts")], "repo string, path string")
    owners = spark.createDataFrame([(1, "src/**", ["@o"]), (2, "*.md", ["@d"])], "rule_no int, pattern string, owners array<string>")
    ignores = spark.createDataFrame([(0, "test"), (1, "*a*")], "pos int, pattern string")
    rules = "pos int, pattern string, project string, issue_type string"
    findings = spark.createDataFrame([("svc-a", ["@o"])], "source string, owners array<string>")
    routed = route(findings, spark.createDataFrame([(0, "svc-*", "P", None)], rules), spark.createDataFrame([(0, "@*", "Q", None)], rules))
    for df in (owners_for(files, owners), *apply_ignores(files, ignores), routed):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    assert routed.first()["project"] == "P" and owners_for(files, owners).first()["pattern"] == "src/**"


def test_newest_ticket_wins_by_either_way(spark):
    findings = spark.createDataFrame([(1, "fp1", ["l", "a", "b"]), (2, "fp2", ["l", "c"]), (3, "fp3", ["l", "z"])], "n int, fingerprint string, identity array<string>")
    tickets = [
        ("T1", 10, False, ["l", "a", "b", "x"]), ("T2", 20, False, ["b", "a", "l"]), ("T3", 30, True, ["l", "a", "b"]), ("T4", 20, False, ["a", "l", "b"]),
        ("T5", 5, False, ["l", "c"]), ("T6", 6, False, ["fp2"]), ("T7", 9, False, ["l"]),
    ]
    found = match_tickets(findings, spark.createDataFrame(tickets, "ticket string, created long, done boolean, labels array<string>"))
    assert sorted((r["n"], r["ticket"]) for r in found.collect()) == [(1, "T2"), (2, "T6"), (3, None)]
    assert found.columns == ["n", "fingerprint", "identity", "ticket"]


def test_islands_of_a_hot_key_merge_across_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "cold", None]), s, s + rng.choice([0, 3, 20, 400])) for s in (rng.randint(0, 20_000) for _ in range(900))]
    rows += [("hot", 5_000, 9_000), ("hot", 9_000, 9_005), ("edge", 10, 20), ("edge", 20, 30), ("edge", 31, 40)]
    want = []
    for key in {r[0] for r in rows}:
        spans = sorted((s, e) for k, s, e in rows if k == key)
        merged = [list(spans[0])]
        for s, e in spans[1:]:
            if s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        want += [(key, s, e) for s, e in merged]
    df = spark.createDataFrame(rows, "k string, start_ms long, end_ms long")
    for bucket in (50, 1000, 10**9):
        got = [tuple(r) for r in union_intervals(df, ["k"], bucket).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_sibling_lists_are_bounded_and_counts_exact(spark):
    rows = [("n", "undeclared", f"undeclared:m.f{i:03d}", f"m.f{i:03d}", "warning") for i in range(100)] + [("n", "undeclared", "undeclared:top", "top", "error")]
    df = spark.createDataFrame(rows, "name string, kind string, key string, path string, severity string")
    found = {r["parent"]: r for r in group_siblings(df, listed=5).collect()}
    assert (found["m"]["fields"], found["m"]["paths"], found["m"]["severity"]) == (100, [f"m.f{i:03d}" for i in range(5)], "warning")
    assert (found[None]["fields"], found[None]["paths"], found[None]["severity"]) == (1, ["top"], "error")
