"""Patterns, formats, conditions, names: small columns against literal expectations."""

import pytest
from pyspark.sql import functions as F

from pactline.functions.conditions import Condition, Watch, payload_path, summary, variant_path, watch_expr
from pactline.functions.formats import format_ok
from pactline.functions.globs import glob_regex, glob_regex_col, path_glob_regex_col
from pactline.functions.names import detail_title, invalid_chars, label, sanitize_name, split_identity
from pactline.functions.text import clip, percent
from pactline.operators.readers import pull_number
from pactline.operators.shape import common_pattern

FORMAT_CASES = {
    "date": (["2024-02-29", "2000-02-29"], ["2023-02-29", "1900-02-29", "2024-13-01", "2024-1-01", "2024-01-01\n", "2024-04-31"]),
    "time": (["12:00:00Z", "23:59:60Z", "01:29:60+01:30"], ["12:00:00", "24:00:00Z", "12:00:60Z", "12:00:00+24:00"]),
    "date-time": (["2024-01-01T12:00:00Z", "2024-01-01 12:00:00.5+02:00", "2024-01-01t12:00:00z"], ["2024-01-01", "2024-01-01T12:00:00", "2024-02-30T12:00:00Z"]),
    "iso-time": (["12:00:00"], ["25:00:00"]),
    "iso-date-time": (["2024-01-01T12:00:00"], ["2024-01-01TT12:00:00"]),
    "duration": (["P1D", "PT5M", "P2W"], ["P", "PT", "1D"]),
    "uri": (["http://a.b/c?d#e", "urn:x:y", "http://[::1]:80/"], ["//a/b", "abc", "http://a b"]),
    "uri-reference": (["/a/b", "a", "", "//h/p", "#f", '/a"b', "http://[v1.a]/"], ["a b", "\\x"]),
    "uri-template": (["http://a/{b}", "{+x}/{y*}"], ["{", "a b"]),
    "url": (["http://example.com/x", "https://a.co:8080"], ["http://10.0.0.1", "ftp//x", "http://localhost"]),
    "email": (["a@b.co", "A.b+c@x-y.org"], ["a@b", "a b@c.de", "@x.de"]),
    "hostname": (["a.b-c.de", "localhost"], ["-a.de", "a..b", "a_b"]),
    "ipv4": (["1.2.3.4", "255.255.255.255"], ["256.1.1.1", "1.2.3.4\n", "01.2.3.4", "1.2.3"]),
    "ipv6": (["::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "fe80::", "1::8"], ["1:2:3", ":::", "12345::", "1:2:3:4:5:6:7:8:9"]),
    "uuid": (["123e4567-e89b-12d3-a456-426614174000", "urn:uuid:123e4567-e89b-12d3-a456-426614174000"], ["123e4567", "1677831-ff2a5b8e8c8aa859"]),
    "json-pointer": (["", "/a/b~0"], ["a", "/~2"]),
    "json-pointer-uri-fragment": (["#", "#/a%20b"], ["/a", "#/ "]),
    "relative-json-pointer": (["0", "1/a", "2#"], ["01", "/a"]),
    "byte": (["", "YWI=", "###\n"], ["###", "abc"]),
    "made-up": (["anything"], []),
}


def test_formats(spark):
    rows = [(f, v, ok) for f, (good, bad) in FORMAT_CASES.items() for ok, vs in ((True, good), (False, bad)) for v in vs]
    df = spark.createDataFrame(rows, "fmt string, v string, ok boolean")
    wrong = df.where(format_ok(F.col("fmt"), F.col("v")) != F.col("ok")).collect()
    assert wrong == []


def test_common_pattern(spark):
    cases = {
        "ids": (["1677831-ff2a5b8e8c8aa859", "1677832-00aa5b8e8c8aa859"], r"^\d{7}-[0-9a-f]{16}$"),
        "lengths": (["ab-1", "abc-22", "abcd-333"], r"^[a-z]{2,4}-\d{1,3}$"),
        "words": (["zebra", "tiger"], "^[a-z]{5}$"),
        "mixed": (["AB12cd", "XY99zz"], "^[0-9A-Za-z]{6}$"),
        "dots": (["a.b/1", "c.d/2"], r"^[a-z]\.[a-z]/\d$"),
        "differ": (["ab-12", "ab12"], None), "one": (["x1", "x1"], None), "blank": (["a1", "", "b2"], None),
        "sentence": (["a b c d e f g h i j", "k l m n o p q r s t"], None),
        "case": (["Ab", "cD"], "^[A-Za-z]{2}$"), "upper": (["A1", "B2"], "^[0-9A-Z]{2}$"),
    }
    rows = [(k, v) for k, (vs, _) in cases.items() for v in vs]
    got = {r["k"]: r["pattern"] for r in common_pattern(spark.createDataFrame(rows, "k string, v string"), ["k"], "v").collect()}
    assert got == {k: p for k, (_, p) in cases.items() if p}


ENVELOPE = (
    '{"source":"client-a","detail-type":"seen","account":"12","detail":{"clientId":"abc-1","count":5,"ratio":5.0,"flag":true,'
    '"none":null,"items":[{"id":"x"},{"id":"y"}],"five":"5","a.b":1}}'
)
CONDITIONS = [
    (Condition("clientId", "abc-1"), True), (Condition("detail.clientId", "abc*"), True), (Condition(".clientId", "*-1"), True),
    (Condition("clientId", "bc*"), False), (Condition("$.account", '"12"'), True), (Condition("$.account", "12"), False),
    (Condition("count", "5"), True), (Condition("ratio", "5"), True), (Condition("five", "5"), False), (Condition("five", '"5"'), True),
    (Condition("count", '"5"'), False), (Condition("flag", "true"), True), (Condition("flag", "false"), False), (Condition("none", "null"), True),
    (Condition("missing", "null"), False), (Condition("items[1].id", "y"), True), (Condition("items[2].id", "y"), False),
    (Condition("clientId", "zzz", "ne"), True), (Condition("clientId", "abc-1", "ne"), False), (Condition("missing", "x", "ne"), False),
    (Condition("none", "x", "ne"), True), (Condition("clientId", "ABC-1"), False), (Condition("clientId", "*"), True),
]


def test_conditions(spark):
    df = spark.createDataFrame([(ENVELOPE, "client-a", "seen")], "m string, source string, event_type string").select(
        F.parse_json("m").alias("envelope"), "source", "event_type"
    )
    exprs = [watch_expr(Watch("w", conditions=(c,))).alias(f"c{i}") for i, (c, _) in enumerate(CONDITIONS)]
    row = df.select(*exprs, watch_expr(Watch("x", source="client*", event_type="seen")).alias("plain"), watch_expr(Watch("y", source="Client*")).alias("case")).first()
    assert [row[f"c{i}"] for i in range(len(CONDITIONS))] == [ok for _, ok in CONDITIONS]
    assert row["plain"] and not row["case"]


def test_paths_and_summary():
    assert payload_path("clientId") == "detail.clientId" and payload_path("$.account") == "account"
    assert payload_path("[0].x") == "detail[0].x" and payload_path("detail[0]") == "detail[0]" and payload_path("details") == "detail.details"
    assert variant_path("items[0].id") == "$['detail']['items'][0]['id']"
    assert variant_path("$.detail-type") == "$['detail-type']"
    assert summary(Watch("w")) == "every event"
    assert summary(Watch("w", source=" a ", conditions=(Condition("x", "1", "ne"),))) == "a · x ≠ 1"
    with pytest.raises(ValueError):
        watch_expr(Watch("w", conditions=(Condition("$", "1"),)))


def test_globs(spark):
    cases = [
        ("*", "anything", True), ("a*c", "abc", True), ("a*c", "abd", False), ("a.c", "abc", False), ("*a", "aba", True), ("a", "A", False),
        ("x[1]*", "x[1]y", True), ("", "", True), ("a*", "ab\n", True), ("a*b", "ab\n", False),
    ]
    df = spark.createDataFrame(cases, "p string, t string, ok boolean")
    assert df.where(F.rlike("t", glob_regex_col(F.col("p"))) != F.col("ok")).count() == 0
    assert glob_regex("a.*") == r"(?s)^a\..*\z"


def test_path_patterns(spark):
    cases = [
        ("*", "x/y", True), ("docs", "a/docs/b.md", True), ("docs", "a/docsx/b", False), ("/docs/", "docs/a", True), ("/docs/", "a/docs/b", False),
        ("*.js", "a/b.js", True), ("/*.js", "a/b.js", False), ("a/*/c", "a/b/c", True), ("a/*/c", "a/b/d/c", False), ("a/**/c", "a/b/d/c", True),
        ("a/**/c", "a/c", True), ("src/**", "src/x/y", True), ("**/test", "q/w/test/e", True), ("build/", "x/build/o", True), ("a.b", "axb", False),
    ]
    df = spark.createDataFrame(cases, "p string, t string, ok boolean")
    wrong = df.where(F.rlike("t", path_glob_regex_col(F.col("p"))) != F.col("ok")).collect()
    assert wrong == []


def test_names(spark):
    df = spark.createDataFrame([("Tide  Tables@a#b",), ("a@b@c",), ("@x",), ("nope",), ("x@",)], "n string")
    source, kind = split_identity(F.col("n"))
    rows = df.select(sanitize_name(F.col("n")).alias("s"), F.array_join(invalid_chars(F.col("n")), "").alias("i"), source.alias("a"), kind.alias("b")).collect()
    assert rows[0]["s"] == "Tide-Tables@a-b" and rows[0]["i"] == " #"
    assert [(r["a"], r["b"]) for r in rows] == [("Tide  Tables", "a#b"), ("a", "b@c"), (None, None), (None, None), (None, None)]
    t = spark.range(1).select(detail_title(F.lit("order_placed-now.x y")).alias("t"), label(F.lit(" items[].sku a\tb ")).alias("l")).first()
    assert (t["t"], t["l"]) == ("OrderPlacedNowXY", "items.sku-a-b")


def test_text(spark):
    row = spark.range(1).select(
        percent(F.lit(1), F.lit(224)).alias("a"), percent(F.lit(0), F.lit(5)).alias("b"), percent(F.lit(1), F.lit(2)).alias("c"), percent(F.lit(1), F.lit(0)).alias("d"),
        clip(F.lit("word " * 40), 20).alias("e"), clip(F.lit(" short "), 20).alias("f"), clip(F.lit("x" * 30), 20).alias("g"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ("1%", "0%", "50%", "0%")
    assert (row["e"], row["f"], row["g"]) == ("word word word word…", "short", "x" * 20 + "…")


def test_pull_numbers(spark):
    cases = [
        ("Merge pull request #181 from a/b", 181), ("feat: add (#42)", 42), ("fix: rename", None), ("chore (#12) and more", None),
    ]
    df = spark.createDataFrame(cases, "s string, n long")
    assert df.where(~pull_number(F.col("s")).eqNullSafe(F.col("n"))).count() == 0
