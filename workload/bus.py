"""The tables the registered queries run on, derived from the given parquet tables.

`events` becomes a bus of JSON messages with known defects, `part` a registry of contract documents,
`documents` a table of source files. Every rule is arithmetic on the row, so the SQL checks count
from the rules and never parse JSON.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.session import configure
from pactline.sources.contracts_io import parse_contracts
from pactline.sources.events import parse_events, split_channels

SOURCE_SQL = (
    "CASE user_id % 4 WHEN 0 THEN 'harbour-desk' WHEN 1 THEN 'billing-invoices'"
    " WHEN 2 THEN 'billing-ledger' ELSE 'Tide Tables' END"
)
# One producer spells one type in title case.
TYPE_SQL = "if(user_id % 4 = 2 AND event_type = 'purchase', 'Purchase', event_type)"
# Published on the external channel only, as redacted copies.
EXTERNAL_ONLY_SQL = "user_id % 4 = 2 AND event_type = 'signup'"

_DETAIL = """concat('{', concat_ws(',',
  CASE WHEN event_id % 20 = 0 THEN NULL WHEN event_id % 33 = 0 THEN '"shipperId":""'
    WHEN event_id % 41 = 0 THEN concat('"shipperId":', cast(user_id AS string))
    ELSE concat('"shipperId":"c-', cast(user_id AS string), '"') END,
  CASE WHEN event_id % 13 = 0 THEN '"amount":null'
    WHEN event_id % 25 = 0 THEN concat('"amount":"', cast(value AS string), '"')
    ELSE concat('"amount":', cast(value AS string)) END,
  CASE WHEN event_id % 17 = 0 THEN '"status":"held"' WHEN event_id % 2 = 0 THEN '"status":"loaded"'
    ELSE '"status":"sailed"' END,
  concat('"k":', regexp_extract(props, '([0-9]+)', 1)),
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '"cargo":null'
    WHEN event_id % 19 = 0 THEN '"cargo":{}'
    ELSE concat('"cargo":{"manifestId":"', cast(1000000 + event_id AS string), '-',
      left(md5(cast(event_id AS string)), 16), '"}') END,
  CASE WHEN event_id % 50 = 1 THEN '"beta":true' END,
  concat('"items":[', array_join(transform(
    filter(array(1, 2), i -> i <= event_id % 3),
    i -> concat('{"sku":"s', cast(i AS string), '","qty":', cast(i AS string), '}')), ','), ']')), '}')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# A task's share of rows whose work is far larger than their bytes.
ROWS_A_TASK = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input of fewer splits than cores; a large table is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def spread_rows(df: DataFrame) -> DataFrame:
    """Deal short rows evenly, `ROWS_A_TASK` a task at most: every row becomes a document, so splits by bytes are too large,
    and those of a file of few row groups are empty but for some."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_A_TASK)))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`event_id, ts, channel, message`: the main channel, and redacted copies of every tenth event."""
    ev = spread_rows(table(spark, sf_dir, "events")).withColumns(
        {"ts": F.col("ts").cast("timestamp"), "_src": F.expr(SOURCE_SQL), "_typ": F.expr(TYPE_SQL), "_ext": F.expr(EXTERNAL_ONLY_SQL)}
    )
    client = "get_json_object(_full, '$.shipperId')"
    ev = ev.withColumn("_full", F.expr(_DETAIL))
    cut = f"if({client} IS NULL, '{{}}', concat('{{\"shipperId\":\"', {client}, '\"}}'))"
    copies = ev.selectExpr(
        "*",
        "explode(filter(array(if(_ext, NULL, '/bus/main'), if(_ext OR event_id % 10 = 0, '/bus/external-events', NULL)),"
        " c -> c IS NOT NULL)) AS channel",
    )
    detail = f"if(channel = '/bus/main', _full, {cut})"
    message = (
        "concat('{\"version\":\"0\",\"id\":\"', cast(event_id AS string), '\",\"detail-type\":\"', _typ,"
        f" '\",\"source\":\"', _src, '\",\"account\":\"', cast(1000 + user_id % 3 AS string), '\",\"detail\":', {detail}, '}}')"
    )
    return copies.selectExpr("event_id", "ts", "channel", f"{message} AS message")


def all_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed events of every channel, redacted copies included."""
    return parse_events(raw_messages(spark, sf_dir))[0]


def bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed events as producers sent them."""
    return split_channels(all_channels(spark, sf_dir))[0]


def document(source: str | None, event_type: str | None, types: dict, payload: str = "Payload") -> str:
    """A contract document around component types."""
    members = ("detail-type", "resources", "detail", "id", "source", "time", "region", "version", "account")
    envelope = {
        "type": "object",
        "required": list(members),
        "x-amazon-events-source": source,
        "x-amazon-events-detail-type": event_type,
        "properties": {m: {"type": "string"} for m in members} | {"detail": {"$ref": f"#/components/schemas/{payload}"}},
    }
    return json.dumps({"openapi": "3.0.0", "components": {"schemas": {"AWSEvent": envelope, **types}}})


def _object(properties: dict, **more) -> dict:
    return {"type": "object", "properties": properties, **more}


_STRING, _INT = {"type": "string"}, {"type": "integer"}
_ITEMS = {"type": "array", "items": _object({"sku": _STRING, "qty": _INT})}
_ANY = {}


def bus_documents() -> dict[str, str]:
    """Contracts over the bus; each stands for one situation a registry report has to tell apart."""
    tracking = _object({"manifestId": _STRING}, nullable=True)
    return {
        "harbour-desk@view": document(
            "harbour-desk", "view",
            {
                "Payload": _object(
                    {
                        "shipperId": _STRING,
                        "amount": {"type": "number"},
                        "status": {"type": "string", "enum": ["loaded", "sailed"]},
                        "cargo": {"$ref": "#/components/schemas/Meta"},
                        "legacy": _STRING,
                        "sessionId": _STRING,
                        "items": _ITEMS,
                    },
                    required=["shipperId", "amount", "sessionId"],
                ),
                "Meta": _object({"manifestId": _STRING, "retired": _STRING}, required=["manifestId"]),
            },
        ),
        "billing-invoices@purchase": document(
            "billing-invoices", "purchase",
            {
                "Payload": _object(
                    {
                        "shipperId": {"type": "string", "nullable": True},
                        "amount": {"type": "number", "nullable": True},
                        "status": _STRING,
                        "k": _INT,
                        "cargo": {"type": "object", "nullable": True},
                        "items": {"type": "array", "items": {"type": "object"}},
                    },
                    additionalProperties=False,
                )
            },
        ),
        "Tide-Tables@click": document(
            "Tide Tables", "click",
            {
                "Payload": _object(
                    {
                        "shipperId": {"type": "string", "minLength": 1},
                        "amount": _ANY,
                        "status": {"type": "string", "enum": ["loaded", "sailed", "held"]},
                        "k": {"type": "integer", "maximum": 50},
                        "cargo": _object({"manifestId": {"type": "string", "format": "uuid"}}, nullable=True, minProperties=1),
                        "beta": {"type": "boolean"},
                        "items": {**_ITEMS, "maxItems": 1},
                    }
                )
            },
        ),
        "billing-ledger@error": document(
            "billing-ledger", "error",
            {
                "Payload": _object(
                    {
                        "shipperId": _ANY, "amount": _ANY, "status": _STRING, "k": _INT, "cargo": tracking,
                        "beta": {"type": "boolean"}, "items": _ITEMS,
                    }
                )
            },
        ),
        "orders-api@nothing": document("orders-api", "nothing", {"Payload": _object({"id": _STRING}, required=["id"])}),
        "billing-ledger@view": document(
            "billing-ledger", "view",
            {"Payload": _object({"shipperId": _ANY, "child": {"$ref": "#/components/schemas/Payload"}})},
        ),
        "billing-ledger@click": document(
            "billing-ledger", "click",
            {"Payload": _object({"shipperId": _ANY, "amount": {"anyOf": [{"type": "number"}, _STRING]}, "items": _ITEMS})},
        ),
        "billing-ledger@purchase": document("billing-ledger", "purchase", {"Payload": _object({"shipperId": {"if": _INT}})}),
        "billing-ledger@signup": document("billing-ledger", "signup", {"Payload": _object({"shipperId": _ANY})}),
        "billing-invoices@error": json.dumps(
            {"openapi": "3.0.0", "components": {"schemas": {"AWSEvent": {"type": "object", "properties": {"detail": {"type": "object"}}}}}}
        ),
    }


def bus_contracts(spark: SparkSession) -> DataFrame:
    rows = [(n, 1, d) for n, d in bus_documents().items()]
    return parse_contracts(configure(spark).createDataFrame(rows, "name string, version int, content string"))[0]


# Declared fields of the bus contracts for the SQL checks, written out by hand, not derived from the
# documents: (contract, path, parent, types, required, enum).
DECLARED = [
    ("harbour-desk@view", "shipperId", "", "string", True, ""),
    ("harbour-desk@view", "amount", "", "number", True, ""),
    ("harbour-desk@view", "status", "", "string", False, "loaded,sailed"),
    ("harbour-desk@view", "cargo", "", "object", False, ""),
    ("harbour-desk@view", "cargo.manifestId", "cargo", "string", True, ""),
    ("harbour-desk@view", "cargo.retired", "cargo", "string", False, ""),
    ("harbour-desk@view", "legacy", "", "string", False, ""),
    ("harbour-desk@view", "sessionId", "", "string", True, ""),
    ("harbour-desk@view", "items", "", "array", False, ""),
    ("harbour-desk@view", "items[]", "items", "object", False, ""),
    ("harbour-desk@view", "items[].sku", "items[]", "string", False, ""),
    ("harbour-desk@view", "items[].qty", "items[]", "integer", False, ""),
    ("billing-invoices@purchase", "shipperId", "", "string,null", False, ""),
    ("billing-invoices@purchase", "amount", "", "number,null", False, ""),
    ("billing-invoices@purchase", "status", "", "string", False, ""),
    ("billing-invoices@purchase", "k", "", "integer", False, ""),
    ("billing-invoices@purchase", "cargo", "", "object,null", False, ""),
    ("billing-invoices@purchase", "items", "", "array", False, ""),
    ("billing-invoices@purchase", "items[]", "items", "object", False, ""),
    ("Tide-Tables@click", "shipperId", "", "string", False, ""),
    ("Tide-Tables@click", "amount", "", "", False, ""),
    ("Tide-Tables@click", "status", "", "string", False, "loaded,sailed,held"),
    ("Tide-Tables@click", "k", "", "integer", False, ""),
    ("Tide-Tables@click", "cargo", "", "object,null", False, ""),
    ("Tide-Tables@click", "cargo.manifestId", "cargo", "string", False, ""),
    ("Tide-Tables@click", "beta", "", "boolean", False, ""),
    ("Tide-Tables@click", "items", "", "array", False, ""),
    ("Tide-Tables@click", "items[]", "items", "object", False, ""),
    ("Tide-Tables@click", "items[].sku", "items[]", "string", False, ""),
    ("Tide-Tables@click", "items[].qty", "items[]", "integer", False, ""),
    ("billing-ledger@error", "shipperId", "", "", False, ""),
    ("billing-ledger@error", "amount", "", "", False, ""),
    ("billing-ledger@error", "status", "", "string", False, ""),
    ("billing-ledger@error", "k", "", "integer", False, ""),
    ("billing-ledger@error", "cargo", "", "object,null", False, ""),
    ("billing-ledger@error", "cargo.manifestId", "cargo", "string", False, ""),
    ("billing-ledger@error", "beta", "", "boolean", False, ""),
    ("billing-ledger@error", "items", "", "array", False, ""),
    ("billing-ledger@error", "items[]", "items", "object", False, ""),
    ("billing-ledger@error", "items[].sku", "items[]", "string", False, ""),
    ("billing-ledger@error", "items[].qty", "items[]", "integer", False, ""),
    ("orders-api@nothing", "id", "", "string", True, ""),
    ("billing-ledger@view", "shipperId", "", "", False, ""),
    ("billing-ledger@view", "child", "", "object", False, ""),
    ("billing-ledger@click", "shipperId", "", "", False, ""),
    ("billing-ledger@click", "amount", "", "", False, ""),
    ("billing-ledger@click", "items", "", "array", False, ""),
    ("billing-ledger@click", "items[]", "items", "object", False, ""),
    ("billing-ledger@click", "items[].sku", "items[]", "string", False, ""),
    ("billing-ledger@click", "items[].qty", "items[]", "integer", False, ""),
    ("billing-ledger@purchase", "shipperId", "", "", False, ""),
    ("billing-ledger@signup", "shipperId", "", "", False, ""),
]

# Contract, its event key, and the wire identity a report shows when the two differ.
MATCHED = [
    ("harbour-desk@view", "harbour-desk", "view"),
    ("billing-invoices@purchase", "billing-invoices", "purchase"),
    ("Tide-Tables@click", "Tide Tables", "click"),
    ("billing-ledger@view", "billing-ledger", "view"),
    ("billing-ledger@click", "billing-ledger", "click"),
    ("billing-ledger@error", "billing-ledger", "error"),
    ("billing-ledger@purchase", "billing-ledger", "Purchase"),
]

_PART_DOC = """concat('{', if(p_partkey % 29 = 0, '', '"openapi":"3.0.0",'), '"components":{"schemas":{"AWSEvent":{"type":"object","required":[',
  if(p_partkey % 11 = 0, '', '"account",'), '"detail-type","resources","detail","id","source","time","region","version"],',
  '"x-amazon-events-source":"svc-', cast(p_partkey % 7 AS string), '","x-amazon-events-detail-type":"',
  if(p_partkey % 13 = 0, 'other', concat('type-', cast(p_partkey AS string))), '","properties":{"detail":{"$ref":"#/components/schemas/',
  if(p_partkey % 17 = 0, 'Gone', 'Payload'), '"},"account":{},"detail-type":{},"id":{},"region":{},"resources":{},"source":{},"time":{},"version":{}}},',
  '"Payload":{"type":"object","required":["partId"', if(version >= 3, '', ',"name"'), '],"properties":{"partId":{"type":"string"},"name":{"type":"string"',
  if(version >= 2, ',"nullable":true', ''), '},"size":{"type":"', if(version = 1, 'integer', 'number'), '"', if(p_partkey % 4 = 0, ',"minimum":1', ''), '},',
  if(version >= 3, '', concat('"kind":{"type":', if(p_partkey % 19 = 0, '["string","null"]', '"string"'), '},')),
  if(version >= 2, '"extra":{"type":"string","enum":["a","b"]},', ''),
  '"meta":{"$ref":"#/components/schemas/Meta"}', if(p_partkey % 3 = 0, ',"tags":{"type":"array","items":{"type":"string"}}', ''),
  '}', if(p_partkey % 5 = 0, ',"additionalProperties":false', ''), '},',
  '"Meta":{"type":"object","required":["note"],"properties":{"note":{"type":"string","format":"', if(p_partkey % 23 = 0, 'weird', 'date-time'), '"}',
  if(p_partkey % 6 = 0, ',"next":{"$ref":"#/components/schemas/Meta"}', ''), '}', if(p_partkey % 10 = 0, concat(',"minProperties":', cast(version AS string)), ''), '}',
  if(p_partkey % 8 = 0, ',"Spare":{"type":"object","properties":{}}', ''), '}}}')"""


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry out of `part`: one contract per part, one to three versions, as text in `content`."""
    versions = spread_rows(table(spark, sf_dir, "part")).selectExpr("*", "explode(sequence(1, cast(1 + p_partkey % 3 AS int))) AS version")
    return versions.selectExpr(
        "p_partkey AS part",
        "concat('svc-', cast(p_partkey % 7 AS string), '@type-', cast(p_partkey AS string)) AS name",
        "version",
        f"{_PART_DOC} AS content",
    )


def part_registry(spark: SparkSession, sf_dir: str, latest: bool = True) -> DataFrame:
    rows = part_documents(spark, sf_dir)
    if latest:
        rows = rows.where("version = 1 + part % 3")
    return parse_contracts(rows)[0]


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files out of `documents`: a little code by rule, and the whole text in a comment."""
    return spread(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "concat('repo-', source) AS repo",
        "concat(CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/test/' WHEN 2 THEN 'infra/' WHEN 3 THEN 'docs/'"
        " WHEN 4 THEN 'lib/api/' ELSE 'src/app/' END, lang, '/f', cast(doc_id AS string),"
        " CASE doc_id % 5 WHEN 0 THEN '.yml' WHEN 1 THEN '.md' ELSE '.ts' END) AS path",
        "CASE WHEN doc_id % 4 = 3 THEN concat(source, '-events') ELSE 'billing-ledger' END AS source",
        "concat('type-', cast(doc_id % 10 AS string)) AS event_type",
        "concat("
        "if(doc_id % 2 = 0, 'use(event.detail.shipperId);\n', ''),"
        "if(doc_id % 3 = 0, 'use(e?.detail?.cargo?.manifestId.length);\n', ''),"
        "if(doc_id % 5 = 0, 'x = detail[\"amount\"]; y = detail.items[0].sku; // detail.secret\n', ''),"
        "if(doc_id % 7 = 0, 'client.PutEvents(detail.k)\n', ''),"
        "if(doc_id % 11 = 0, 'const eventPattern = 1\n', ''),"
        "if(doc_id % 13 = 0, 'z = payload.get(\"note\")\n', ''),"
        "'/* ', text, ' */') AS content",
    )
