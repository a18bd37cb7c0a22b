"""Common table expressions for the SQL checks: the bus counted from its rules, no JSON involved."""

from __future__ import annotations

from workload.bus import DECLARED, MATCHED

_B = """b AS (
  SELECT event_id AS e, ts, epoch_us(ts) // 1000 AS ms, user_id AS u, CASE WHEN user_id % 4 = 2 AND event_type = 'purchase' THEN 'Purchase' ELSE event_type END AS t, value AS val,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CASE user_id % 4 WHEN 0 THEN 'harbour-desk' WHEN 1 THEN 'billing-invoices' WHEN 2 THEN 'billing-ledger' ELSE 'Tide Tables' END AS src,
    (user_id % 4 = 2 AND event_type = 'signup') AS ext,
    CASE WHEN event_id % 20 = 0 THEN 'absent' WHEN event_id % 33 = 0 THEN 'blank' WHEN event_id % 41 = 0 THEN 'integer' ELSE 'string' END AS client,
    CASE WHEN event_id % 13 = 0 THEN 'null' WHEN event_id % 25 = 0 THEN 'string' ELSE 'number' END AS amount,
    CASE WHEN event_id % 17 = 0 THEN 'held' WHEN event_id % 2 = 0 THEN 'loaded' ELSE 'sailed' END AS status,
    CASE WHEN event_id % 7 = 0 THEN 'absent' WHEN event_id % 11 = 0 THEN 'null' WHEN event_id % 19 = 0 THEN 'empty' ELSE 'full' END AS meta,
    event_id % 50 = 1 AS beta, event_id % 3 AS n,
    CAST(1000000 + event_id AS VARCHAR) || '-' || left(md5(CAST(event_id AS VARCHAR)), 16) AS tracking
  FROM events),
bus AS (SELECT * FROM b WHERE NOT ext)"""

_OCC = """occ AS (
  SELECT e, ts, ms, src, t, '' AS path, CAST(NULL AS VARCHAR) AS parent, 'object' AS type, CAST(NULL AS VARCHAR) AS v FROM bus
  UNION ALL SELECT e, ts, ms, src, t, 'shipperId', '', CASE client WHEN 'integer' THEN 'integer' ELSE 'string' END,
    CASE client WHEN 'integer' THEN CAST(u AS VARCHAR) WHEN 'blank' THEN '""' ELSE '"c-' || u || '"' END FROM bus WHERE client <> 'absent'
  UNION ALL SELECT e, ts, ms, src, t, 'amount', '', amount, CASE amount WHEN 'null' THEN 'null' WHEN 'string' THEN '"' || val || '"' ELSE CAST(val AS VARCHAR) END FROM bus
  UNION ALL SELECT e, ts, ms, src, t, 'status', '', 'string', '"' || status || '"' FROM bus
  UNION ALL SELECT e, ts, ms, src, t, 'k', '', 'integer', CAST(k AS VARCHAR) FROM bus
  UNION ALL SELECT e, ts, ms, src, t, 'cargo', '', CASE meta WHEN 'null' THEN 'null' ELSE 'object' END, CASE meta WHEN 'null' THEN 'null' END FROM bus WHERE meta <> 'absent'
  UNION ALL SELECT e, ts, ms, src, t, 'cargo.manifestId', 'cargo', 'string', '"' || tracking || '"' FROM bus WHERE meta = 'full'
  UNION ALL SELECT e, ts, ms, src, t, 'beta', '', 'boolean', 'true' FROM bus WHERE beta
  UNION ALL SELECT e, ts, ms, src, t, 'items', '', 'array', NULL FROM bus
  UNION ALL SELECT e, ts, ms, src, t, 'items[]', 'items', 'object', NULL FROM bus, range(1, 3) r(i) WHERE i <= n
  UNION ALL SELECT e, ts, ms, src, t, 'items[].sku', 'items[]', 'string', '"s' || i || '"' FROM bus, range(1, 3) r(i) WHERE i <= n
  UNION ALL SELECT e, ts, ms, src, t, 'items[].qty', 'items[]', 'integer', CAST(i AS VARCHAR) FROM bus, range(1, 3) r(i) WHERE i <= n)"""


def _values(rows) -> str:
    def lit(x):
        return str(x).upper() if isinstance(x, bool) else "'" + x + "'"

    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


_M = f"""matched AS (SELECT * FROM (VALUES {_values(MATCHED)}) x(name, src, t))"""
_D = f"""declared AS (SELECT name, path, parent, CASE WHEN types = '' THEN [] ELSE string_split(types, ',') END AS types, required,
  CASE WHEN enum = '' THEN NULL ELSE list_transform(string_split(enum, ','), lambda x: '"' || x || '"') END AS enum
  FROM (VALUES {_values(DECLARED)}) x(name, path, parent, types, required, enum))"""

_G = """g AS (SELECT m.name, o.* FROM occ o JOIN matched m USING (src, t)),
prof AS (SELECT name, path, any_value(parent) AS parent, count(DISTINCT e) AS seen_in, list_sort(list(DISTINCT type)) AS types,
  count(DISTINCT CASE WHEN type = 'object' THEN e END) AS n_object, count(DISTINCT CASE WHEN v = '""' THEN e END) AS blank_in FROM g GROUP BY ALL),
sampled AS (SELECT name, seen_in AS sampled FROM prof WHERE path = ''),
carr AS (SELECT name, path AS parent, n_object AS carriers FROM prof)"""

_DRIFT = """undeclared AS (SELECT name, path, types, seen_in FROM prof p WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.name = p.name AND d.path = p.path)),
missing AS (SELECT d.name, d.path, coalesce(p.seen_in, 0) AS seen_in, c.carriers FROM declared d JOIN carr c ON c.name = d.name AND c.parent = d.parent
  LEFT JOIN prof p ON p.name = d.name AND p.path = d.path WHERE d.required AND coalesce(p.seen_in, 0) < c.carriers),
unused AS (SELECT d.name, d.path, d.required FROM declared d WHERE d.name IN (SELECT name FROM sampled)
  AND NOT EXISTS (SELECT 1 FROM prof p WHERE p.name = d.name AND p.path = d.path)
  AND NOT EXISTS (SELECT 1 FROM missing m WHERE m.name = d.name AND m.path = d.path)),
bad AS (SELECT g.*, d.types AS declared, d.enum FROM g JOIN declared d ON d.name = g.name AND d.path = g.path),
wrong AS (SELECT * FROM bad WHERE len(declared) > 0 AND NOT list_contains(declared, type) AND NOT (type = 'integer' AND list_contains(declared, 'number'))),
outside AS (SELECT * FROM bad WHERE enum IS NOT NULL AND NOT list_contains(enum, v)),
blank AS (SELECT p.name, p.path, p.seen_in, p.blank_in FROM prof p JOIN declared d USING (name, path) WHERE d.required AND p.blank_in > 0)"""

_VIOL = """viol AS (
  SELECT name, e, ms, 'wrongType' AS class, path, 'wrongType' AS constraint_at FROM wrong
  UNION ALL SELECT name, e, ms, 'outsideEnum', path, 'outsideEnum' FROM outside
  UNION ALL SELECT m.name, e, ms, 'missingRequired', 'shipperId', 'missingRequired' FROM bus JOIN matched m USING (src, t) WHERE m.name = 'harbour-desk@view' AND client = 'absent'
  UNION ALL SELECT m.name, e, ms, 'missingRequired', 'sessionId', 'missingRequired' FROM bus JOIN matched m USING (src, t) WHERE m.name = 'harbour-desk@view'
  UNION ALL SELECT m.name, e, ms, 'missingRequired', 'cargo.manifestId', 'missingRequired' FROM bus JOIN matched m USING (src, t) WHERE m.name = 'harbour-desk@view' AND meta = 'empty'
  UNION ALL SELECT m.name, e, ms, 'undeclared', 'beta', 'undeclared' FROM bus JOIN matched m USING (src, t) WHERE m.name = 'billing-invoices@purchase' AND beta
  UNION ALL SELECT m.name, e, ms, 'other', 'shipperId', '/properties/shipperId/minLength' FROM bus JOIN matched m USING (src, t) WHERE m.name = 'Tide-Tables@click' AND client = 'blank'
  UNION ALL SELECT m.name, e, ms, 'other', 'k', '/properties/k/maximum' FROM bus JOIN matched m USING (src, t) WHERE m.name = 'Tide-Tables@click' AND k > 50
  UNION ALL SELECT m.name, e, ms, 'other', 'cargo.manifestId', '/properties/cargo/properties/manifestId/format' FROM bus JOIN matched m USING (src, t) WHERE m.name = 'Tide-Tables@click' AND meta = 'full'
  UNION ALL SELECT m.name, e, ms, 'other', 'items', '/properties/items/maxItems' FROM bus JOIN matched m USING (src, t) WHERE m.name = 'Tide-Tables@click' AND n = 2
  UNION ALL SELECT m.name, e, ms, 'other', 'cargo', '/properties/cargo/minProperties' FROM bus JOIN matched m USING (src, t) WHERE m.name = 'Tide-Tables@click' AND meta = 'empty'
  UNION ALL SELECT m.name, e, ms, 'other', 'amount', '/properties/amount/anyOf' FROM bus JOIN matched m USING (src, t) WHERE m.name = 'billing-ledger@click' AND amount = 'null'),
open_ AS (SELECT m.name, count(*) AS undecided FROM bus JOIN matched m USING (src, t) WHERE m.name = 'billing-ledger@purchase' AND client <> 'absent' GROUP BY ALL),
fail AS (SELECT name, class, path, constraint_at, count(DISTINCT e) AS affected, count(*) AS occurrences FROM viol GROUP BY ALL)"""

_ISS = """drift AS (
  SELECT name, 'wrongType' AS kind, path, count(DISTINCT e) AS stat FROM wrong GROUP BY ALL
  UNION ALL SELECT name, 'outsideEnum', path, count(DISTINCT e) FROM outside WHERE v <> 'null' GROUP BY ALL
  UNION ALL SELECT name, 'missingRequired', path, carriers - seen_in FROM missing
  UNION ALL SELECT name, 'emptyRequired', path, blank_in FROM blank
  UNION ALL SELECT name, 'undeclared', path, seen_in FROM undeclared
  UNION ALL SELECT name, 'neverSeen', path, 0 FROM unused),
iss AS (
  SELECT d.name, d.kind, d.kind || ':' || d.path AS key, d.path, d.stat, f.affected IS NOT NULL AS rejects,
    CASE WHEN f.affected IS NOT NULL AND d.kind <> 'undeclared' THEN f.affected ELSE d.stat END AS affected
  FROM drift d LEFT JOIN fail f ON f.name = d.name AND f.class = d.kind AND f.path = d.path
  UNION ALL SELECT f.name, 'rejected', 'rejected:' || f.path || ':' || f.constraint_at, f.path, f.affected, TRUE, f.affected
  FROM fail f WHERE f.class = 'other'),
issues AS (SELECT i.*, CASE WHEN rejects THEN 'error' WHEN kind = 'neverSeen' THEN 'info' ELSE 'warning' END AS severity, s.sampled
  FROM iss i JOIN sampled s USING (name)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, affected DESC, path,
  list_position(['wrongType','outsideEnum','missingRequired','emptyRequired','undeclared','neverSeen','rejected'], kind), key) AS rank FROM issues)"""

_LEVELS = {
    "bus": [_B],
    "occ": [_B, _OCC],
    "prof": [_B, _OCC, _M, _D, _G],
    "drift": [_B, _OCC, _M, _D, _G, _DRIFT],
    "viol": [_B, _OCC, _M, _D, _G, _DRIFT, _VIOL],
    "issues": [_B, _OCC, _M, _D, _G, _DRIFT, _VIOL, _ISS],
}


def sql(level: str, body: str, extra: str = "") -> str:
    """A check on top of one of the shared expressions; `extra` adds further ones."""
    ctes = list(_LEVELS[level]) + ([extra] if extra else [])
    return "WITH " + ",\n".join(ctes) + "\n" + body
