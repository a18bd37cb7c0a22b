"""Contract documents as tables: field rows, reference graph, relaxation, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.functions.names import detail_title, event_key, is_id_like, path_step_sql, sanitize_name, split_identity
from pactline.session import cut
from pactline.sources.contracts_io import ENVELOPE

REF_PREFIX = "#/components/schemas/"

# Keywords whose meaning a path table cannot carry.
UNGRADABLE_KEYWORDS = ("allOf", "not", "if", "dependencies", "patternProperties", "propertyNames", "contains")
UNGRADABLE_FORMATS = ("regex",)
# Alternatives are graded where each is no more than a type; these members besides say nothing about a value.
ALTERNATIVES = ("anyOf", "oneOf")
_PLAIN_BRANCH = "array('type', 'nullable', 'title', 'description')"


# What a field row takes of a schema, read at once: a read for each would look the members up anew, row by row. Kinds are
# asked of variants; only the names of `properties` are wanted, so their values are not read.
_MEMBERS = (
    "struct<type:variant,nullable:boolean,enum:array<variant>,const:variant,format:string,pattern:string,minLength:bigint,"
    "maxLength:bigint,minimum:double,maximum:double,exclusiveMinimum:variant,exclusiveMaximum:variant,multipleOf:double,"
    "minItems:bigint,maxItems:bigint,uniqueItems:boolean,minProperties:bigint,maxProperties:bigint,"
    "additionalProperties:variant,required:array<string>,properties:map<string,boolean>,items:struct<items:variant>,"
    + ",".join(f"`{k}`:variant" for k in (*UNGRADABLE_KEYWORDS, *ALTERNATIVES))
    + ">"
)


def _kind(v: str, path: str) -> str:
    return f"schema_of_variant(try_variant_get({v}, '{path}', 'variant'))"


def _branches(keyword: str, value: str, path: str = "$") -> str:
    """Types admitted by the branches of `anyOf` or `oneOf`, at `path` of `value`; NULL where a branch holds more than types.

    `oneOf` wants exactly one branch to match, so its types must not overlap.
    """
    of = f"try_variant_get({value}, '{path}', 'array<variant>')"
    plain = (
        f"forall({of}, b -> {_kind('b', '$.type')} RLIKE '^(STRING|ARRAY<STRING>)$'"
        f" AND size(array_except(map_keys(try_variant_get(b, '$', 'map<string,variant>')), {_PLAIN_BRANCH})) = 0)"
    )
    types = (
        f"flatten(transform({of}, b -> concat("
        f"if({_kind('b', '$.type')} = 'STRING', array(try_variant_get(b, '$.type', 'string')), try_variant_get(b, '$.type', 'array<string>')),"
        " if(coalesce(try_variant_get(b, '$.nullable', 'boolean'), false), array('null'), cast(array() AS array<string>)))))"
    )
    apart = "true"
    if keyword == "oneOf":
        apart = f"size({types}) = size(array_distinct({types})) AND NOT (array_contains({types}, 'number') AND array_contains({types}, 'integer'))"
    return f"CASE WHEN size({of}) > 0 AND {plain} AND ({apart}) THEN array_distinct({types}) END"


def _bound(member: str) -> str:
    return f"CASE WHEN schema_of_variant(_m.{member}) RLIKE '^(BIGINT|DEC|DOUBLE|FLOAT)' THEN try_variant_get(_m.{member}, '$', 'double') END"


def _keywords(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Read the keywords of each node's schema `_s`, in steps so nothing is read twice."""
    none = "cast(array() AS array<string>)"
    nodes = nodes.selectExpr(*keep, f"try_variant_get(_s, '$', '{_MEMBERS}') AS _m")
    nodes = nodes.selectExpr(
        "*",
        "schema_of_variant(_m.type) AS _type_kind",
        "schema_of_variant(_m.additionalProperties) AS _more_kind",
        *[f"{_branches(k, f'_m.{k}')} AS _{k}" for k in ALTERNATIVES],
    )
    marks = [f"if(_m.`{k}` IS NULL, NULL, '{k}')" for k in UNGRADABLE_KEYWORDS]
    marks += [f"if(_m.{k} IS NULL OR _{k} IS NOT NULL, NULL, '{k}')" for k in ALTERNATIVES]
    marks.append("if(_more_kind LIKE 'OBJECT%', 'additionalProperties', NULL)")
    marks.append("if(_m.items.items IS NULL, NULL, 'items of items')")
    marks += [f"if(_m.format = '{f}', 'format {f}', NULL)" for f in UNGRADABLE_FORMATS]
    read = nodes.selectExpr(
        *keep,
        "CASE WHEN _type_kind = 'STRING' THEN array(try_variant_get(_m.type, '$', 'string'))"
        " WHEN _type_kind LIKE 'ARRAY%' THEN try_variant_get(_m.type, '$', 'array<string>')"
        f" WHEN _m.properties IS NOT NULL THEN array('object') ELSE {none} END AS _types",
        "_m.type IS NOT NULL AS typed",
        "coalesce(_m.nullable, false) AS nullable",
        "transform(_m.enum, x -> to_json(x)) AS _enum",
        "to_json(_m.const) AS const_json",
        "_m.format AS format",
        "_m.pattern AS pattern",
        "_m.minLength AS min_len",
        "_m.maxLength AS max_len",
        "_m.minimum AS minimum",
        "_m.maximum AS maximum",
        f"{_bound('exclusiveMinimum')} AS above",
        f"{_bound('exclusiveMaximum')} AS below",
        "_m.multipleOf AS multiple_of",
        "_m.minItems AS min_items",
        "_m.maxItems AS max_items",
        "coalesce(_m.uniqueItems, false) AS unique_items",
        "_m.minProperties AS min_props",
        "_m.maxProperties AS max_props",
        "_anyOf AS any_of",
        "_oneOf AS one_of",
        "coalesce(_more_kind = 'BOOLEAN' AND NOT try_variant_get(_m.additionalProperties, '$', 'boolean'), false) AS closed",
        f"coalesce(_m.required, {none}) AS required_names",
        f"coalesce(map_keys(_m.properties), {none}) AS declared_names",
        f"filter(array({', '.join(marks)}), x -> x IS NOT NULL) AS ungradable",
    )
    return read.selectExpr(
        "* EXCEPT (_types, _enum)",
        "if(nullable AND size(_types) > 0 AND NOT array_contains(_types, 'null'), array_append(_types, 'null'), _types) AS types",
        "if(nullable AND NOT array_contains(_enum, 'null'), array_append(_enum, 'null'), _enum) AS enum_json",
    )


def payload_type(doc: str = "doc") -> Column:
    """Type the envelope's `detail` refers to; NULL when it is inlined or absent."""
    ref = F.try_variant_get(doc, f"$.components.schemas.{ENVELOPE}.properties.detail['$ref']", "string")
    return F.when(ref.startswith(REF_PREFIX), F.substr(ref, F.lit(len(REF_PREFIX) + 1)))


def _resolve(raw: str, link: str | None = None) -> tuple[str, str]:
    """Reference target and effective schema of a raw node, as SQL; `link` is its `$ref` where that is read already."""
    ref = link or f"try_variant_get({raw}, '$[\"$ref\"]', 'string')"
    name = f"CASE WHEN {ref} LIKE '{REF_PREFIX}%' THEN substr({ref}, {len(REF_PREFIX) + 1}) END"
    target = f"element_at(_schemas, {name})"
    return f"if({target} IS NULL, NULL, {name})", f"coalesce({target}, {raw})"


_PLACE = ("path", "parent_path", "leaf", "required", "ref_target", "via_ref", "owner_type", "depth", "cyclic")
# What the walk reads of a schema, at once.
_BELOW = "struct<properties:map<string,variant>,items:variant,required:array<string>>"


def _expand(contracts: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """Walk the schema tree, one generator step per level; a node leaves with its first child."""
    schemas = F.try_variant_get("doc", "$.components.schemas", "map<string,variant>")
    base = (
        contracts.select(*keys, payload_type().alias("_type"), F.explode(F.array(schemas)).alias("_schemas"))
        .withColumn("_s", F.expr("element_at(_schemas, _type)"))
        .where("_s IS NOT NULL")
    )
    node = (
        "named_struct('path', {path}, 'parent_path', {parent}, 'leaf', {leaf}, 'required', {required},"
        " 'ref_target', {ref}, 'via_ref', {via}, 'owner_type', {owner}, 'depth', {depth}, 'cyclic', {cyclic}, '_s', {s})"
    )
    text = "cast(NULL AS string)"
    root = node.format(
        path="''", parent=text, leaf="''", required="false", ref=text, via="false", owner="_type", depth="0",
        cyclic="false", s="_s",
    )
    df = base.selectExpr(
        *keys, "_schemas", "'prop' AS _kind", "array(_type) AS _stack", f"{root} AS _node",
        f"slice(array({root}), 1, 0) AS _pend", "false AS _done",
    )
    for _ in range(levels):
        df = df.selectExpr("*", f"if(_done OR _node.cyclic, NULL, try_variant_get(_node._s, '$', '{_BELOW}')) AS _below")
        df = df.selectExpr(
            "* EXCEPT (_below)",
            "_below.required AS _required",
            "_below.properties IS NULL AS _is_item",
            "CASE WHEN _below.properties IS NOT NULL THEN map_entries(_below.properties)"
            " WHEN _kind = 'prop' AND _node.depth > 0 AND _node.ref_target IS NULL AND _below.items IS NOT NULL"
            " THEN array(named_struct('key', '[]', 'value', _below.items)) END AS _kids",
        )
        df = df.selectExpr("* EXCEPT (_kids)", "posexplode_outer(_kids) AS (_pos, _kid)")
        df = df.selectExpr("*", "try_variant_get(_kid.value, '$[\"$ref\"]', 'string') AS _link")
        ref, schema = _resolve("_kid.value", "_link")
        df = df.selectExpr("*", f"{ref} AS _ref", f"{schema} AS _next")
        child = node.format(
            path="CASE WHEN _is_item THEN concat(_node.path, '[]')"
            f" ELSE concat(if(_node.path = '', '', concat(_node.path, '.')), {path_step_sql('_kid.key')}) END",
            parent="_node.path",
            leaf="_kid.key",
            required="NOT _is_item AND coalesce(array_contains(_required, _kid.key), false)",
            ref="_ref",
            via="_node.via_ref OR _node.ref_target IS NOT NULL",
            owner="coalesce(_node.ref_target, _node.owner_type)",
            depth="_node.depth + 1",
            cyclic="coalesce(array_contains(_stack, _ref), false)",
            s="_next",
        )
        df = df.selectExpr(
            *keys,
            "_schemas",
            "CASE WHEN _pos IS NULL THEN _kind WHEN _is_item THEN 'item' ELSE 'prop' END AS _kind",
            "if(_pos IS NULL OR _ref IS NULL, _stack, array_append(_stack, _ref)) AS _stack",
            f"if(_pos IS NULL, _node, {child}) AS _node",
            "CASE WHEN _pos IS NULL THEN _pend WHEN _pos = 0 THEN array_append(_pend, _node)"
            " ELSE slice(_pend, 1, 0) END AS _pend",
            "_pos IS NULL AS _done",
        )
    return df


def contract_fields(
    contracts: DataFrame, keys: tuple[str, ...] = ("name", "version"), levels: int = 4
) -> DataFrame:
    """Declared fields of every contract, one row per path; the payload type itself is path ''.

    References are followed and cycles stop where they close. The walk is unrolled; where a document
    turns out to nest deeper it is unrolled further, so depth is never cut. The table is as large as
    the registry and written once, since every check joins it.
    """
    keys = list(keys)
    while True:
        walked = _expand(contracts, keys, levels).selectExpr(*keys, "_done", "inline(array_append(_pend, _node))")
        table = cut(_keywords(walked, [*keys, *_PLACE, "_done"]))
        if table.isStreaming or table.where("NOT _done").limit(1).count() == 0:
            return table.drop("_done")
        levels *= 2


def declared_paths(fields: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Sorted distinct paths, over all contracts or the named ones."""
    rows = fields.where("depth > 0")
    if names is not None:
        rows = rows.where(F.col("name").isin(*names))
    return rows.select("path").distinct().orderBy("path")


def schema_nodes(contracts: DataFrame, keys: tuple[str, ...] = ("name",), levels: int = 8) -> DataFrame:
    """Every JSON node of the document: pointer, key, owning type, and its value.

    One row per (document, node); the input of the reference graph and of lint.
    """
    from pactline.operators.observe import observe

    events = contracts.select(*keys, F.col("doc").alias("detail"))
    return observe(events, keys, levels, container_json=True, include_root=True)


def ref_edges(contracts: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """`(from_type, target)` for each reference between component types."""
    types = contracts.select(
        *keys,
        F.explode(F.map_entries(F.try_variant_get("doc", "$.components.schemas", "map<string,variant>"))).alias("t"),
    )
    text = F.to_json(F.col("t.value"))
    return types.select(
        *keys,
        F.col("t.key").alias("from_type"),
        F.explode(F.regexp_extract_all(text, F.lit(rf'"\$ref":"{REF_PREFIX}([^"]+)"'), 1)).alias("target"),
    )


def component_types(contracts: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Named types of every document."""
    return contracts.select(
        *keys,
        F.explode(F.map_keys(F.try_variant_get("doc", "$.components.schemas", "map<string,variant>"))).alias("type"),
    )


def ref_usage(contracts: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Uses of every type; zero marks an unused one (the envelope is never counted as unused)."""
    uses = ref_edges(contracts, keys).groupBy(*keys, F.col("target").alias("type")).agg(F.count("*").alias("uses"))
    return (
        component_types(contracts, keys)
        .join(uses, [*keys, "type"], "left")
        .fillna(0, ["uses"])
        .withColumn("unused", (F.col("uses") == 0) & (F.col("type") != ENVELOPE))
    )


def ref_referrers(contracts: DataFrame, type_name: str, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Types that refer to one type."""
    return ref_edges(contracts, keys).where(F.col("target") == type_name).select(*keys, "from_type").distinct()


def _is_relaxable(kind: str = "type") -> Column:
    return F.try_variant_get("schema", f"$.{kind}", "string") == "object"


def _types_table(contracts: DataFrame, keys: list[str]) -> DataFrame:
    return contracts.select(
        *keys,
        F.explode(F.map_entries(F.try_variant_get("doc", "$.components.schemas", "map<string,variant>"))).alias("t"),
    ).select(*keys, F.col("t.key").alias("type"), F.col("t.value").alias("schema"))


def relax(fields: DataFrame) -> DataFrame:
    """Open every object and keep only ID-like fields required, on the field table."""
    kept = F.filter("required_names", lambda n: is_id_like(n))
    return fields.withColumns(
        {
            "required": F.col("required") & is_id_like(F.col("leaf")),
            "closed": F.lit(False),
            "required_names": kept,
        }
    )


def relax_changes(contracts: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Types whose `required` list would shrink, with its length before and after."""
    keys = list(keys)
    listed = F.coalesce(F.try_variant_get("schema", "$.required", "array<string>"), F.array().cast("array<string>"))
    applies = _is_relaxable() & F.try_variant_get("schema", "$.properties", "variant").isNotNull()
    after = F.when(applies, F.size(F.filter(listed, lambda n: is_id_like(n)))).otherwise(F.size(listed))
    return (
        _types_table(contracts, keys)
        .where(F.col("type") != ENVELOPE)
        .select(*keys, "type", F.size(listed).alias("required_before"), after.alias("required_after"))
        .where("required_before <> required_after")
    )


def relax_documents(contracts: DataFrame) -> DataFrame:
    """Relaxed documents: same members, objects opened, `required` reduced to ID-like names.

    Rebuilt per type as a map of its members, so everything else in the document stays as it is.
    """
    listed = "filter(try_variant_get(e.value, '$.required', 'array<string>'), n -> n RLIKE '(?i)(id|ids|uuid|arn)$')"
    members = "try_variant_get(e.value, '$', 'map<string,variant>')"
    opened = (
        f"map_concat(map_filter({members}, (k, v) -> k <> 'additionalProperties' AND (k <> 'required' OR"
        " NOT map_contains_key(" + members + ", 'properties'))), map('additionalProperties', parse_json('true')),"
        f" if(map_contains_key({members}, 'properties') AND size({listed}) > 0,"
        f" map('required', to_variant_object({listed})), cast(map() AS map<string,variant>)))"
    )
    schemas = (
        "to_variant_object(transform_values(try_variant_get(doc, '$.components.schemas', 'map<string,variant>'),"
        f" (name, e0) -> if(name = '{ENVELOPE}' OR NOT coalesce(try_variant_get(e0, '$.type', 'string') = 'object', false),"
        " e0, to_variant_object(" + opened.replace("e.value", "e0") + "))))"
    )
    components = (
        "to_variant_object(map_concat(map_filter(try_variant_get(doc, '$.components', 'map<string,variant>'),"
        f" (k, v) -> k <> 'schemas'), map('schemas', {schemas})))"
    )
    whole = (
        "to_variant_object(map_concat(map_filter(try_variant_get(doc, '$', 'map<string,variant>'),"
        f" (k, v) -> k <> 'components'), map('components', {components})))"
    )
    has = F.try_variant_get("doc", "$.components.schemas", "variant").isNotNull()
    return contracts.withColumn("doc", F.when(has, F.expr(whole)).otherwise(F.col("doc")))


def list_contracts(contracts: DataFrame) -> DataFrame:
    """Latest version per name, by number; source and type split leniently."""
    latest = contracts.groupBy("name").agg(F.max("version").alias("version"), F.count("*").alias("versions"))
    source, event_type = split_identity(F.col("name"))
    return latest.select(
        "name", "version", "versions", source.alias("source"), event_type.alias("event_type")
    ).orderBy("name")


def match_contracts(contracts: DataFrame, keys: DataFrame) -> DataFrame:
    """The event key every contract is graded against: exact, title form, then sanitised spelling.

    `wire_identity` is set when the events spell their identity differently from the contract name.
    Both sides hold one row per event type.
    """
    names = contracts.select("name").distinct()
    source, event_type = split_identity(F.col("name"))
    spelled = names.withColumns({"_src": source, "_typ": event_type}).where("_src IS NOT NULL").select(
        "name", F.concat("_src", F.lit("@"), detail_title(F.col("_typ"))).alias("_title")
    )
    wanted = spelled.select(
        "name",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("rank"), F.col("name").alias("spelling")),
                F.struct(F.lit(2).alias("rank"), F.col("_title").alias("spelling")),
                F.struct(F.lit(3).alias("rank"), F.col("name").alias("spelling")),
                F.struct(F.lit(4).alias("rank"), F.col("_title").alias("spelling")),
            )
        ).alias("w"),
    ).select("name", "w.*", (F.col("w.rank") > 2).alias("by_sanitized"))
    live = keys.select("source", "event_type", event_key(F.col("source"), F.col("event_type")).alias("event_key"))
    clean = sanitize_name(F.col("event_key"))
    offered = live.withColumn("spelling", F.col("event_key")).withColumn("by_sanitized", F.lit(False)).unionByName(
        live.where(clean != F.col("event_key"))
        .withColumn("spelling", clean)
        .withColumn("by_sanitized", F.lit(True))
    )
    best = F.row_number().over(W.partitionBy("name").orderBy("rank", "event_key"))
    return (
        wanted.join(offered, ["spelling", "by_sanitized"])
        .withColumn("_rn", best)
        .where("_rn = 1")
        .select(
            "name",
            "source",
            "event_type",
            F.when(F.col("event_key") != F.col("name"), F.col("event_key")).alias("wire_identity"),
        )
    )
