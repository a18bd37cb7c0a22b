"""Contract lint: what would be refused, ignored or contradictory, one finding per rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions.formats import KNOWN_FORMATS, NUMERIC_ONLY_FORMATS
from pactline.functions.names import detail_title, event_key, sanitize_name, split_identity
from pactline.operators.contracts import REF_PREFIX
from pactline.sources.contracts_io import ENVELOPE

# ---------------------------------------------------------------------------
# The vocabulary of the two specifications a document has to satisfy.
# ---------------------------------------------------------------------------
ENVELOPE_REQUIRED = (
    "detail-type", "resources", "detail", "id", "source", "time", "region", "version", "account",
)
DRAFT_07 = ("http://json-schema.org/draft-07/schema", "https://json-schema.org/draft-07/schema")
POST_DRAFT_07 = (
    "$defs", "dependentRequired", "dependentSchemas", "prefixItems", "unevaluatedProperties", "unevaluatedItems",
    "minContains", "maxContains", "$dynamicRef",
)
TRANSLATABLE = ("const", "examples", "$schema", "$id", "id", "$comment")
ANNOTATIONS = ("description", "title", "example", "examples", "deprecated", "default", "$comment")
OPENAPI_30_KEYWORDS = (
    "title", "multipleOf", "maximum", "exclusiveMaximum", "minimum", "exclusiveMinimum", "maxLength", "minLength",
    "pattern", "maxItems", "minItems", "uniqueItems", "maxProperties", "minProperties", "required", "enum", "type",
    "allOf", "oneOf", "anyOf", "not", "items", "properties", "additionalProperties", "description", "format",
    "default", "nullable", "discriminator", "readOnly", "writeOnly", "xml", "externalDocs", "example", "deprecated",
    "$ref",
)
MAX_LISTED = 5


def lint_nodes(contracts: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Every schema position of every document: `pointer` and the schema itself as VARIANT.

    Positions are the component types and, below them, the values of `properties`, `items`,
    `additionalProperties`, and the members of `allOf`, `anyOf`, `oneOf`, `not`; sample data under
    `example` or `default` is not one.
    """
    keys = list(keys)
    schemas = contracts.select(
        *keys,
        F.explode(F.map_entries(F.try_variant_get("doc", "$.components.schemas", "map<string,variant>"))).alias("t"),
    )
    one = (
        "filter(transform(array('items', 'additionalProperties', 'not'), k -> named_struct("
        "'pointer', concat(n.pointer, '/', k), 's', element_at(try_variant_get(n.s, '$', 'map<string,variant>'), k))),"
        " c -> coalesce(schema_of_variant(c.s) LIKE 'OBJECT%', false))"
    )
    named = (
        "flatten(transform(array('properties', 'definitions', 'patternProperties'), k -> coalesce(transform(map_entries("
        "try_variant_get(element_at(try_variant_get(n.s, '$', 'map<string,variant>'), k), '$', 'map<string,variant>')),"
        " e -> named_struct('pointer', concat(n.pointer, '/', k, '/', e.key), 's', e.value)), array())))"
    )
    listed = (
        "flatten(transform(array('allOf', 'anyOf', 'oneOf', 'items'), k -> coalesce(transform(try_variant_get("
        "element_at(try_variant_get(n.s, '$', 'map<string,variant>'), k), '$', 'array<variant>'),"
        " (x, i) -> named_struct('pointer', concat(n.pointer, '/', k, '/', cast(i AS string)), 's', x)), array())))"
    )
    kind = "array<struct<pointer:string,s:variant>>"
    text = "to_json(t.value)"
    walk = (
        f"aggregate(sequence(1, 1 + length({text}) - length(replace({text}, '{{', ''))),"
        f" named_struct('f', cast(array(named_struct('pointer', concat('/components/schemas/', t.key), 's', t.value)) AS {kind}),"
        f" 'o', cast(array() AS {kind})),"
        f" (a, i) -> if(size(a.f) = 0, a, named_struct('f', cast(filter(flatten(transform(a.f,"
        f" n -> concat({one}, {named}, {listed}))), c -> coalesce(schema_of_variant(c.s) LIKE 'OBJECT%', false)) AS {kind}),"
        f" 'o', cast(concat(a.o, a.f) AS {kind}))), a -> concat(a.o, a.f))"
    )
    return schemas.select(*keys, F.col("t.key").alias("component"), F.expr(f"inline({walk})")).withColumnRenamed("s", "schema")


def _kind(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("schema", path, "variant")), F.lit(""))


def _has(name: str) -> Column:
    return F.array_contains("_members", name)


def _rules() -> list[tuple[Column, Column, Column]]:
    """(code, severity, holds) of every rule about one schema position."""
    fmt = F.when(_kind("$.format") == "STRING", F.try_variant_get("schema", "$.format", "string"))
    dialect = F.regexp_replace(F.try_variant_get("schema", "$['$schema']", "string"), "#+$", "")
    number = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"
    beside = F.array_except(
        F.array_remove("_members", "$ref"), F.array(*[F.lit(a) for a in ANNOTATIONS])
    )
    unknown = F.filter(
        F.array_except("_members", F.array(*[F.lit(k) for k in OPENAPI_30_KEYWORDS + TRANSLATABLE])),
        lambda k: ~k.startswith("x-"),
    )
    foreign = _has("$schema") & ~dialect.isin(*DRAFT_07)
    rules = [
        ("type-list", "error", _kind("$.type").startswith("ARRAY")),
        ("type-null", "error", (_kind("$.type") == "STRING") & (F.try_variant_get("schema", "$.type", "string") == "null")),
        ("tuple-items", "error", _kind("$.items").startswith("ARRAY")),
        ("numeric-exclusive", "error", _kind("$.exclusiveMinimum").rlike(number) | _kind("$.exclusiveMaximum").rlike(number)),
        ("boolean-exclusive", "error", (_kind("$.exclusiveMinimum") == "BOOLEAN") | (_kind("$.exclusiveMaximum") == "BOOLEAN")),
        ("untyped-nullable", "error", _has("nullable") & ~_has("type")),
        ("foreign-dialect", "error", foreign),
        ("ref-siblings", "warning", _has("$ref") & (F.size(beside) > 0)),
        ("numeric-format", "warning", fmt.isin(*NUMERIC_ONLY_FORMATS)),
        ("unknown-format", "warning", ~fmt.isin(*KNOWN_FORMATS)),
        ("unknown-keyword", "error", F.size(unknown) > 0),
    ]
    rules += [(f"post-draft-07 {k}", "warning", _has(k)) for k in POST_DRAFT_07]
    rules += [
        (f"not-openapi {k}", "error", _has(k) & (~foreign if k == "$schema" else F.lit(True))) for k in TRANSLATABLE
    ]
    return [(F.lit(code), F.lit(sev), F.coalesce(cond, F.lit(False))) for code, sev, cond in rules]


def _envelope_rules() -> list[tuple[str, Column, Column]]:
    """(code, severity, holds) of every rule about the document as a whole."""
    env = "$.components.schemas." + ENVELOPE
    no_list = F.array().cast("array<string>")
    wanted = F.array(*[F.lit(n) for n in ENVELOPE_REQUIRED])
    required = F.coalesce(F.try_variant_get("doc", env + ".required", "array<string>"), no_list)
    props = F.map_keys(F.try_variant_get("doc", env + ".properties", "map<string,variant>"))
    types = F.coalesce(F.map_keys(F.try_variant_get("doc", "$.components.schemas", "map<string,variant>")), no_list)
    source = F.try_variant_get("doc", env + "['x-amazon-events-source']", "string")
    detail_type = F.try_variant_get("doc", env + "['x-amazon-events-detail-type']", "string")
    declared = event_key(source, detail_type)
    name_source, name_type = split_identity(F.col("name"))
    discovered = (name_source == source) & (name_type == detail_title(detail_type))
    sanitized = F.col("name") == sanitize_name(declared)
    differs = declared != F.col("name")
    ref = F.try_variant_get("doc", env + ".properties.detail['$ref']", "string")
    has_env = F.array_contains(types, ENVELOPE)
    has_detail = F.coalesce(F.array_contains(props, "detail"), F.lit(False))
    err, warn = F.lit("error"), F.lit("warning")
    return [
        ("missing-openapi", warn, F.try_variant_get("doc", "$.openapi", "string").isNull()),
        ("no-schemas", err, F.size(types) == 0),
        ("no-envelope", err, (F.size(types) > 0) & ~has_env),
        ("envelope-type", err, has_env & ~F.coalesce(F.try_variant_get("doc", env + ".type", "string") == "object", F.lit(False))),
        ("envelope-required", err, has_env & (F.size(F.array_except(wanted, required)) > 0)),
        ("envelope-source", err, has_env & source.isNull()),
        ("envelope-detail-type", err, has_env & detail_type.isNull()),
        ("envelope-no-properties", err, has_env & props.isNull()),
        ("envelope-properties", warn, has_env & (F.size(F.array_except(wanted, props)) > 0)),
        ("identity-discovery", warn, has_env & differs & discovered),
        ("identity-sanitized", warn, has_env & differs & ~discovered & sanitized),
        ("identity-mismatch", err, has_env & differs & ~discovered & ~sanitized),
        ("detail-missing", err, has_env & ~has_detail),
        ("detail-inlined", warn, has_env & has_detail & ref.isNull()),
        ("detail-ref-foreign", err, has_env & ~ref.startswith(REF_PREFIX)),
        ("detail-ref-dangling", err, has_env & ref.startswith(REF_PREFIX) & ~F.array_contains(types, F.replace(ref, F.lit(REF_PREFIX), F.lit("")))),
        ("registry-name", err, F.col("name").rlike(r"[^A-Za-z0-9_.\-@]")),
    ]


def lint(contracts: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """One row per (contract, rule): severity, how many sites, the first five of them, sorted."""
    keys = list(keys)
    nodes = lint_nodes(contracts, tuple(keys)).withColumn(
        "_members", F.coalesce(F.map_keys(F.try_variant_get("schema", "$", "map<string,variant>")), F.array().cast("array<string>"))
    )
    hits = F.filter(
        F.array(*[F.when(cond, F.struct(code.alias("code"), sev.alias("severity"))) for code, sev, cond in _rules()]),
        lambda h: h.isNotNull(),
    )
    at_nodes = nodes.select(*keys, "pointer", F.inline(hits))
    whole = F.filter(
        F.array(
            *[
                F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), sev.alias("severity")))
                for code, sev, cond in _envelope_rules()
            ]
        ),
        lambda h: h.isNotNull(),
    )
    at_docs = contracts.select(*keys, F.lit("").alias("pointer"), F.inline(whole))
    found = at_nodes.unionByName(at_docs)
    # Sites of one rule in one document: bounded by that document.
    return found.groupBy(*keys, "code", "severity").agg(
        F.count("*").alias("sites"), F.slice(F.array_sort(F.collect_list("pointer")), 1, MAX_LISTED).alias("shown")
    )
