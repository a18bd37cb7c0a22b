"""Registered queries over the contract registry derived from `part`, and over identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactline.functions.names import detail_title, invalid_chars, sanitize_name
from pactline.operators import contracts as ct
from pactline.operators import versions as ver
from pactline.operators.lint import lint
from pactline.sources.contracts_io import parse_contracts
from workload import bus as w

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# One row per contract version of the registry, from the rules alone.
_R = """v AS (SELECT p_partkey AS k, unnest(range(1, 2 + p_partkey % 3)) AS version FROM part),
r AS (SELECT k, CAST(version AS INTEGER) AS version, 'svc-' || k % 7 || '@type-' || k AS name, version = 1 + k % 3 AS latest FROM v)"""
_F = """f AS (
  SELECT k, version, name, latest, 'partId' AS path, 'string' AS types, TRUE AS required, FALSE AS nullable, NULL AS fmt, NULL AS ref, 'Payload' AS owner FROM r WHERE k % 17 <> 0
  UNION ALL SELECT k, version, name, latest, 'name', CASE WHEN version >= 2 THEN 'string,null' ELSE 'string' END, version < 3, version >= 2, NULL, NULL, 'Payload' FROM r WHERE k % 17 <> 0
  UNION ALL SELECT k, version, name, latest, 'size', CASE WHEN version = 1 THEN 'integer' ELSE 'number' END, FALSE, FALSE, NULL, NULL, 'Payload' FROM r WHERE k % 17 <> 0
  UNION ALL SELECT k, version, name, latest, 'kind', CASE WHEN k % 19 = 0 THEN 'string,null' ELSE 'string' END, FALSE, FALSE, NULL, NULL, 'Payload' FROM r WHERE version < 3 AND k % 17 <> 0
  UNION ALL SELECT k, version, name, latest, 'extra', 'string', FALSE, FALSE, NULL, NULL, 'Payload' FROM r WHERE version >= 2 AND k % 17 <> 0
  UNION ALL SELECT k, version, name, latest, 'meta', 'object', FALSE, FALSE, NULL, 'Meta', 'Payload' FROM r WHERE k % 17 <> 0
  UNION ALL SELECT k, version, name, latest, 'meta.note', 'string', TRUE, FALSE, CASE WHEN k % 23 = 0 THEN 'weird' ELSE 'date-time' END, NULL, 'Meta' FROM r WHERE k % 17 <> 0
  UNION ALL SELECT k, version, name, latest, 'meta.next', 'object', FALSE, FALSE, NULL, 'Meta', 'Meta' FROM r WHERE k % 6 = 0 AND k % 17 <> 0
  UNION ALL SELECT k, version, name, latest, 'tags', 'array', FALSE, FALSE, NULL, NULL, 'Payload' FROM r WHERE k % 3 = 0 AND k % 17 <> 0
  UNION ALL SELECT k, version, name, latest, 'tags[]', 'string', FALSE, FALSE, NULL, NULL, 'Payload' FROM r WHERE k % 3 = 0 AND k % 17 <> 0)"""


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def registry(spark, sf, latest=True):
    return w.part_registry(spark, sf, latest)


def fields(spark, sf):
    return ct.contract_fields(registry(spark, sf, latest=False))


@query(
    "contract_fields",
    f"WITH {_R}, {_F} SELECT name, version, path, types, required, nullable, fmt AS format, ref AS ref_target, owner AS owner_type FROM f",
)
def contract_fields(spark, sf):
    rows = fields(spark, sf).where("depth > 0")
    return rows.select(
        "name", "version", "path", F.array_join("types", ",").alias("types"), "required", "nullable", "format", "ref_target", "owner_type"
    )


@query("declared_paths", f"WITH {_R}, {_F} SELECT DISTINCT path FROM f")
def declared_paths(spark, sf):
    return ct.declared_paths(fields(spark, sf))


@query(
    "ref_usage",
    f"""WITH {_R}, u AS (SELECT name, 'AWSEvent' AS type, 0 AS uses FROM r WHERE latest UNION ALL SELECT name, 'Payload', CASE WHEN k % 17 = 0 THEN 0 ELSE 1 END FROM r WHERE latest
    UNION ALL SELECT name, 'Meta', 1 + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END FROM r WHERE latest UNION ALL SELECT name, 'Spare', 0 FROM r WHERE latest AND k % 8 = 0)
    SELECT name, type, CAST(uses AS BIGINT) AS uses, uses = 0 AND type <> 'AWSEvent' AS unused FROM u""",
)
def ref_usage(spark, sf):
    return ct.ref_usage(registry(spark, sf))


@query(
    "ref_referrers",
    f"WITH {_R} SELECT name, 'Payload' AS from_type FROM r WHERE latest UNION ALL SELECT name, 'Meta' FROM r WHERE latest AND k % 6 = 0",
)
def ref_referrers(spark, sf):
    return ct.ref_referrers(registry(spark, sf), "Meta")


@query(
    "identity_names",
    """SELECT DISTINCT p_name || ' #' || p_brand || '..x' AS raw, regexp_replace(regexp_replace(p_name || ' #' || p_brand || '..x', '[^A-Za-z0-9_.@-]', '-', 'g'), '-{2,}', '-', 'g') AS sanitized,
    array_to_string(list_transform(list_filter(string_split_regex(p_name || '-' || lower(p_type), '[-_. ]'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '') AS title, ' ,#' AS illegal FROM part""",
)
def identity_names(spark, sf):
    raw = F.concat("p_name", F.lit(" #"), "p_brand", F.lit("..x"))
    return w.table(spark, sf, "part").select(
        raw.alias("raw"), sanitize_name(raw).alias("sanitized"),
        detail_title(F.concat("p_name", F.lit("-"), F.lower("p_type"))).alias("title"),
        F.array_join(invalid_chars(raw), ",").alias("illegal"),
    ).distinct()


@query(
    "relaxed_fields",
    f"WITH {_R}, {_F} SELECT name, path, required AND regexp_matches(path, '(?i)(id|ids|uuid|arn)$') AS required, FALSE AS closed FROM f WHERE latest",
)
def relaxed_fields(spark, sf):
    rows = ct.relax(ct.contract_fields(registry(spark, sf)))
    return rows.where("depth > 0").select("name", "path", "required", "closed")


@query(
    "relax_changes",
    f"""WITH {_R} SELECT name, 'Payload' AS type, CAST(2 AS INTEGER) AS required_before, CAST(1 AS INTEGER) AS required_after FROM r WHERE latest AND version < 3
    UNION ALL SELECT name, 'Meta', 1, 0 FROM r WHERE latest""",
)
def relax_changes(spark, sf):
    return ct.relax_changes(registry(spark, sf))


@query(
    "relaxed_documents",
    f"""WITH {_R} SELECT name, TRUE AS open, 'partId' AS payload_required, CAST(NULL AS VARCHAR) AS meta_required, CAST(CASE WHEN k % 11 = 0 THEN 8 ELSE 9 END AS INTEGER) AS envelope_required FROM r WHERE latest""",
)
def relaxed_documents(spark, sf):
    docs = ct.relax_documents(registry(spark, sf))
    base = "$.components.schemas"
    return docs.select(
        "name",
        F.try_variant_get("doc", f"{base}.Payload.additionalProperties", "boolean").alias("open"),
        F.array_join(F.try_variant_get("doc", f"{base}.Payload.required", "array<string>"), ",").alias("payload_required"),
        F.array_join(F.try_variant_get("doc", f"{base}.Meta.required", "array<string>"), ",").alias("meta_required"),
        F.size(F.try_variant_get("doc", f"{base}.AWSEvent.required", "array<string>")).alias("envelope_required"),
    )


@query(
    "contract_lint",
    f"""WITH {_R}, l AS (SELECT * FROM r WHERE latest)
    SELECT name, code, severity, CAST(n AS BIGINT) AS sites, shown FROM (
    SELECT name, 'missing-openapi' AS code, 'warning' AS severity, 1 AS n, '' AS shown FROM l WHERE k % 29 = 0
    UNION ALL SELECT name, 'envelope-required', 'error', 1, '' FROM l WHERE k % 11 = 0
    UNION ALL SELECT name, 'identity-mismatch', 'error', 1, '' FROM l WHERE k % 13 = 0
    UNION ALL SELECT name, 'detail-ref-dangling', 'error', 1, '' FROM l WHERE k % 17 = 0
    UNION ALL SELECT name, 'type-list', 'error', 1, '/components/schemas/Payload/properties/kind' FROM l WHERE k % 19 = 0 AND version < 3
    UNION ALL SELECT name, 'unknown-format', 'warning', 1, '/components/schemas/Meta/properties/note' FROM l WHERE k % 23 = 0
    UNION ALL SELECT name, 'unknown-keyword', 'error', 1, '/components/schemas/AWSEvent' FROM l WHERE FALSE)""",
)
def contract_lint(spark, sf):
    return lint(registry(spark, sf)).withColumn("shown", F.array_join("shown", ","))


_D = f"""{_R}, {_F}, cols AS (SELECT *, CASE WHEN path IN ('meta', 'meta.next') AND k % 10 = 0 THEN version END AS least FROM f),
d AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.path, b.path) AS path, coalesce(b.version, a.version + 1) AS version,
  CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN a.path IS NULL OR b.path IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN a.least <> b.least THEN 'least members was ' || a.least || ', is ' || b.least END,
    CASE WHEN a.required <> b.required THEN 'required was true, is false' END,
    CASE WHEN a.path = 'size' AND a.types <> b.types THEN 'types was integer, is number' WHEN a.nullable <> b.nullable THEN 'types was string, is string, null' END) END AS detail
  FROM cols a FULL JOIN cols b ON a.name = b.name AND a.path = b.path AND a.version + 1 = b.version
  WHERE coalesce(b.version, 2) > 1 AND (b.version IS NOT NULL OR NOT a.latest)),
ch AS (SELECT * FROM d WHERE change <> 'changed' OR detail <> '')"""


def _diffs(spark, sf):
    """Every version of every contract against the one before."""
    rows = fields(spark, sf)
    older = rows.withColumn("version", F.col("version") + 1).join(rows.select("name", "version").distinct(), ["name", "version"], "left_semi")
    return ver.contract_diff(older, rows.where("version > 1"), ("name", "version"))


@query(
    "contract_diff",
    f"WITH {_D} SELECT name, CAST(version AS INTEGER) AS version, path, change, detail FROM ch",
)
def contract_diff(spark, sf):
    return _diffs(spark, sf).withColumn("detail", F.array_join("detail", "; "))


@query(
    "diff_counts",
    f"WITH {_D} SELECT name, CAST(version AS INTEGER) AS version, count_if(change = 'added') AS added, count_if(change = 'removed') AS removed, count_if(change = 'changed') AS changed FROM ch GROUP BY ALL",
)
def diff_counts(spark, sf):
    return ver.diff_counts(_diffs(spark, sf), ("name", "version"))


@query("change_ledger", f"WITH {_D} SELECT name, path, CAST(version AS INTEGER) AS version, change, detail FROM ch")
def change_ledger(spark, sf):
    return ver.change_ledger(fields(spark, sf)).withColumn("detail", F.array_join("detail", "; "))


@query(
    "recurring_fields",
    f"WITH {_D} SELECT name, path, count(*) AS changes, CAST(max(version) AS INTEGER) AS last_version FROM ch GROUP BY ALL HAVING count(*) > 1",
)
def recurring_fields(spark, sf):
    return ver.recurring_fields(ver.change_ledger(fields(spark, sf)))


@query(
    "reconcile_plan",
    f"""WITH {_R}, l AS (SELECT * FROM r WHERE latest) SELECT CASE WHEN k % 31 = 0 THEN 'error' WHEN k % 5 = 0 THEN 'create' WHEN k % 3 = 0 THEN 'update' ELSE 'unchanged' END AS action, count(*) AS contracts FROM l GROUP BY ALL""",
)
def reconcile_plan(spark, sf):
    docs = w.part_documents(spark, sf).where("version = 1 + part % 3")
    # Same documents, spaced differently; some changed, some new, some unreadable.
    text = F.when(F.col("part") % 31 == 0, F.left("content", F.lit(40))).when(
        (F.col("part") % 3 == 0) & (F.col("part") % 5 != 0), F.replace("content", F.lit('"Meta":{"type"'), F.lit('"Meta":{"title":"t","type"'))
    ).otherwise(F.replace("content", F.lit('":{'), F.lit('" : { ')))
    good, bad = parse_contracts(docs.withColumn("content", text))
    candidate = good.select("name", "doc").unionByName(bad.select("name", F.lit(None).cast("variant").alias("doc")))
    live = registry(spark, sf).where("part % 5 <> 0").select("name", "doc")
    return ver.reconcile(candidate, live).groupBy("action").agg(F.count("*").alias("contracts"))


@query(
    "search_contracts",
    f"""WITH {_R} SELECT name, CAST(4 AS INTEGER) AS rank, 'S' AS bucket FROM r WHERE latest AND contains(name, 'svc-3') AND contains(name, 'type-1')""",
)
def search_contracts(spark, sf):
    return ver.search_contracts(registry(spark, sf), " SVC-3 type-1").select("name", "rank", "bucket")


@query(
    "search_groups",
    f"""WITH {_R} SELECT 'svc-' || k % 7 AS source, CAST(CASE WHEN min(k) IS NULL THEN 4 ELSE min(CASE WHEN starts_with('type-' || k, 'type-12') THEN 1 ELSE 3 END) END AS INTEGER) AS rank,
    count(*) AS contracts, k % 7 = 5 AS pinned FROM r WHERE latest AND contains('type-' || k, 'type-12') GROUP BY ALL""",
)
def search_groups(spark, sf):
    return ver.search_groups(registry(spark, sf), "type-12", pinned=("svc-5",))


@query(
    "list_contracts",
    f"WITH {_R} SELECT name, max(version) AS version, count(*) AS versions, 'svc-' || any_value(k) % 7 AS source, 'type-' || any_value(k) AS event_type FROM r GROUP BY name",
)
def list_contracts(spark, sf):
    return ct.list_contracts(registry(spark, sf, latest=False))


@query(
    "contract_source",
    f"""WITH {_R} SELECT 'read' AS state, count(*) AS contracts FROM r WHERE latest AND k % 31 <> 0 UNION ALL SELECT 'refused', count(*) FROM r WHERE latest AND k % 31 = 0""",
)
def contract_source(spark, sf):
    docs = w.part_documents(spark, sf).where("version = 1 + part % 3")
    # Documents as objects, as JSON strings, and cut short.
    quoted = F.concat(F.lit('"'), F.replace("content", F.lit('"'), F.lit('\\"')), F.lit('"'))
    text = F.when(F.col("part") % 31 == 0, F.left("content", F.lit(40))).when(F.col("part") % 2 == 0, quoted).otherwise(F.col("content"))
    good, bad = parse_contracts(docs.withColumn("content", text))
    readable = good.where(F.try_variant_get("doc", "$.components.schemas.Payload", "variant").isNotNull())
    return readable.agg(F.count("*").alias("contracts")).select(F.lit("read").alias("state"), "contracts").unionByName(
        bad.agg(F.count("*").alias("contracts")).select(F.lit("refused").alias("state"), "contracts")
    )


@query(
    "latest_versions",
    f"WITH {_R} SELECT name, version FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS rn FROM r) WHERE rn <= 2",
)
def latest_versions(spark, sf):
    return ver.newest_versions(registry(spark, sf, latest=False).select("name", "version"), 2)
