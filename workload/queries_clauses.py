"""Registered queries over a second bus, whose contracts hold composition, maps keyed by ids, and arrays of arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactline.plans import check as ck
from pactline.session import configure
from pactline.sources.contracts_io import parse_contracts
from workload import bus as w

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_DETAIL = """concat('{"legs":{"total":', if(event_id % 31 = 0, '"?"', cast(event_id % 9 AS string)),
  ',"leg-', cast(user_id AS string), '-1":{"port":"P","load":', cast(event_id % 4 AS string), '}',
  CASE event_id % 3 WHEN 1 THEN concat(',"leg-', cast(user_id AS string), '-2":{"load":1}')
    WHEN 2 THEN concat(',"leg-', cast(user_id AS string), '-2":{"port":7,"load":2}') ELSE '' END,
  '},"grid":[[', cast(event_id % 5 AS string), ',', cast(event_id % 7 AS string), '],', if(event_id % 11 = 0, '["x",1,"y"]', '[1]'),
  if(event_id % 13 = 0, ',2', ''), ']',
  CASE event_id % 4 WHEN 0 THEN ',"party":{"id":"a"}' WHEN 1 THEN ',"party":{"name":"b"}' WHEN 2 THEN ',"party":{"id":"a","name":"b"}' ELSE '' END,
  ',"fee":', CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN '"x"' WHEN 2 THEN '"xyz"' ELSE cast(event_id % 6 AS string) END,
  ',"note":"', repeat('n', cast(event_id % 6 AS int)), '"}')"""

_STRING, _INT, _NUMBER = {"type": "string"}, {"type": "integer"}, {"type": "number"}


def _object(properties: dict, **more) -> dict:
    return {"type": "object", "properties": properties, **more}


_PARTIES = {"oneOf": [_object({"id": _STRING}, required=["id"]), _object({"name": _STRING}, required=["name"])]}
_PAYLOADS = {
    "view": _object({"legs": _object({"total": _INT}, additionalProperties=_object({"port": _STRING, "load": _INT}, required=["port"]))}),
    "click": _object({"party": _PARTIES, "fee": {"allOf": [_NUMBER, {"minimum": 1}, {"maximum": 4}]}}),
    "purchase": _object(
        {
            "grid": {"type": "array", "items": {"type": "array", "items": _INT}},
            "fee": {"anyOf": [{"type": "number", "minimum": 3}, {"type": "string", "minLength": 2}, {"type": "null"}]},
        }
    ),
    "error": _object({"note": {"not": {"type": "string", "minLength": 4}}, "party": {"anyOf": [_PARTIES, {"type": "null"}]}}),
    "signup": _object({"fee": {"anyOf": [{"if": _STRING}, _NUMBER]}}),
}


def _events(spark, sf):
    rows = w.spread_rows(w.table(spark, sf, "events")).withColumn("text", F.expr(_DETAIL))
    return rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("dock").alias("source"), "event_type", F.parse_json("text").alias("detail")
    )


def _check(spark, sf) -> ck.Check:
    rows = [(f"dock@{t}", 1, w.document("dock", t, {"Payload": p})) for t, p in _PAYLOADS.items()]
    contracts = parse_contracts(configure(spark).createDataFrame(rows, "name string, version int, content string"))[0]
    return ck.Check(_events(spark, sf), contracts)


_SQL = """WITH ev AS (SELECT event_id AS e, 'dock@' || event_type AS name FROM events),
viol AS (
  SELECT name, e, 'legs.total' AS path, 'wrongType' AS pos, 1 AS n FROM ev WHERE name = 'dock@view' AND e % 31 = 0
  UNION ALL SELECT name, e, 'legs.*.port', 'missingRequired', 1 FROM ev WHERE name = 'dock@view' AND e % 3 = 1
  UNION ALL SELECT name, e, 'legs.*.port', 'wrongType', 1 FROM ev WHERE name = 'dock@view' AND e % 3 = 2
  UNION ALL SELECT name, e, 'party', '/properties/party/oneOf', 1 FROM ev WHERE name = 'dock@click' AND e % 4 = 2
  UNION ALL SELECT name, e, 'fee', 'wrongType', 1 FROM ev WHERE name = 'dock@click' AND e % 6 < 3
  UNION ALL SELECT name, e, 'fee', '/properties/fee/allOf/2/maximum', 1 FROM ev WHERE name = 'dock@click' AND e % 6 = 5
  UNION ALL SELECT name, e, 'grid[][]', 'wrongType', 2 FROM ev WHERE name = 'dock@purchase' AND e % 11 = 0
  UNION ALL SELECT name, e, 'grid[]', 'wrongType', 1 FROM ev WHERE name = 'dock@purchase' AND e % 13 = 0
  UNION ALL SELECT name, e, 'fee', '/properties/fee/anyOf', 1 FROM ev WHERE name = 'dock@purchase' AND e % 6 = 1
  UNION ALL SELECT name, e, 'note', '/properties/note/not', 1 FROM ev WHERE name = 'dock@error' AND e % 6 > 3
  UNION ALL SELECT name, e, 'party', '/properties/party/anyOf', 1 FROM ev WHERE name = 'dock@error' AND e % 4 = 2)
"""


def query(name: str, oracle: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLE[name] = _SQL + oracle
        return fn

    return register


@query(
    "clause_violations",
    "SELECT name, path, pos AS constraint_at, count(DISTINCT e) AS affected, CAST(sum(n) AS BIGINT) AS occurrences FROM viol GROUP BY ALL",
)
def clause_violations(spark, sf):
    return _check(spark, sf).failures.select("name", "path", F.col("constraint").alias("constraint_at"), "affected", "occurrences")


@query(
    "clause_verdicts",
    """SELECT name, count(*) AS sampled, count(*) FILTER (name <> 'dock@signup' AND NOT bad) AS passed, count(*) FILTER (bad) AS failed,
    count(*) FILTER (name = 'dock@signup') AS undecided
    FROM (SELECT name, e, (name, e) IN (SELECT (name, e) FROM viol) AS bad FROM ev) GROUP BY ALL""",
)
def clause_verdicts(spark, sf):
    return _check(spark, sf).verdicts


@query(
    "clause_rejections",
    """SELECT name, CASE WHEN pos = 'wrongType' THEN 'wrongType:' || path
    ELSE 'rejected:' || path || ':' || pos END AS key, count(DISTINCT e) AS events FROM viol GROUP BY ALL""",
)
def clause_rejections(spark, sf):
    """Each event graded on its own."""
    c = _check(spark, sf)
    found = ck.event_issues(c.graded, c.rules, c.clauses).where("rejects")
    return found.groupBy("name", "key").agg(F.count("*").alias("events"))


@query(
    "member_map_profile",
    """SELECT path, count(*) AS seen_in FROM (
      SELECT unnest(['', 'legs', 'legs.total', 'legs.*', 'legs.*.port', 'legs.*.load', 'grid', 'grid[]', 'grid[][]', 'fee', 'note']) AS path, e
      FROM ev WHERE name = 'dock@view'
      UNION ALL SELECT unnest(['party']), e FROM ev WHERE name = 'dock@view' AND e % 4 < 3
      UNION ALL SELECT unnest(['party.id']), e FROM ev WHERE name = 'dock@view' AND e % 4 IN (0, 2)
      UNION ALL SELECT unnest(['party.name']), e FROM ev WHERE name = 'dock@view' AND e % 4 IN (1, 2)) GROUP BY ALL""",
)
def member_map_profile(spark, sf):
    """Members named by ids share the path of their wildcard, whatever their number."""
    return _check(spark, sf).profile.where("name = 'dock@view'").select("path", "seen_in")
