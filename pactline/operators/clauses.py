"""Composition and wildcards of a contract as tables: clauses, and what each asks of a value.

The field table has one row a path. What it can't say is here: `allOf`, `anyOf`, `oneOf`, `not`, the schema that
`additionalProperties` gives to all other members (path step `*`), arrays of arrays, and elements of a referenced array. All
of it becomes rows (clause, path, constraints), so it is graded by the same joins and checks as the field table:

- Clause '' holds always. Its rows join the observations of whole payloads.
- Every branch of a composition is a clause of its own, with paths from the composed value on. A composed value is walked once
  for each branch; broken rows fold to the branches that fail, and those to the verdict: some branch must hold (`anyOf`),
  exactly one (`oneOf`), none (`not`), all (`allOf`). Compositions inside branches are folded first, level by level.

There is no validator: no schema is interpreted while events are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.functions.names import path_step_sql
from pactline.operators import contracts as ct
from pactline.operators import violations as v
from pactline.operators.observe import observe
from pactline.session import broadcast_checked, cut

COMPOSED = ("allOf", "anyOf", "oneOf", "not")
#: Marks of the field table that these tables answer.
ANSWERED = (*COMPOSED, "additionalProperties", "items of items")

_KID = "struct<kind:string,key:string,value:variant>"
_OBJECT = "'OBJECT%'"
# Contracts without any of this in their types have nothing beyond the field table.
_SPECIAL = r'"(allOf|anyOf|oneOf|not)":|"additionalProperties":\{|"items":.*"items":'


@dataclass(frozen=True)
class Clauses:
    """`rows`: constraints by `name, clause, path`. `compositions`: one row each, with the ids of its branches. `wild`: for each
    clause, the members that a wildcard parent declares by name. `nesting`: compositions inside each other."""

    rows: DataFrame
    compositions: DataFrame
    wild: DataFrame
    nesting: int


def _special(doc: str = "doc") -> Column:
    """Whether the contract's types hold anything that the field table can't say; more may answer yes."""
    types = f"try_variant_get({doc}, '$.components.schemas', 'map<string,variant>')"
    arrays = F.expr(f"exists(map_values({types}), t -> try_variant_get(t, '$.items', 'variant') IS NOT NULL)")
    payload = F.expr(f"try_variant_get(element_at({types}, _type), '$[\"$ref\"]', 'string') IS NOT NULL")
    return F.coalesce(F.to_json(F.try_variant_get(doc, "$.components.schemas", "variant")).rlike(_SPECIAL) | arrays | payload, F.lit(False))


def _kids() -> str:
    """The schemas below a node, in one array."""

    def of(keyword: str, kind: str) -> str:
        return f"if(schema_of_variant(try_variant_get(s, '$.{keyword}', 'variant')) LIKE {kind}, try_variant_get(s, '$.{keyword}', '{{}}'), NULL)"

    def one(kind: str, key: str, value: str) -> str:
        return f"if({value} IS NULL, array(), array(named_struct('kind', '{kind}', 'key', {key}, 'value', {value})))"

    props = "try_variant_get(s, '$.properties', 'map<string,variant>')"
    items = of("items", _OBJECT).format("variant")
    rest = f"if(patterned, NULL, {of('additionalProperties', _OBJECT).format('variant')})"
    parts = [
        f"coalesce(transform(map_entries({props}), e -> named_struct('kind', 'prop', 'key', e.key, 'value', e.value)), array())",
        one("item", "'[]'", items), one("rest", "'*'", rest),
        one("not", "'0'", "try_variant_get(s, '$.not', 'variant')"),
    ]
    for k in ("allOf", "anyOf", "oneOf"):
        listed = f"try_variant_get(s, '$.{k}', 'array<variant>')"
        if k != "allOf":  # alternatives of plain types are columns of the field table
            listed = f"if(_{k} IS NULL, {listed}, NULL)"
        parts.append(f"coalesce(transform({listed}, (b, i) -> named_struct('kind', '{k}', 'key', cast(i AS string), 'value', b)), array())")
    return "concat(" + ", ".join(f"cast({p} AS array<{_KID}>)" for p in parts) + ")"


def _nodes(contracts: DataFrame, keys: list[str]) -> DataFrame:
    """Every schema below the payload type, level by level; a level is contract-sized and written once."""
    base = (
        contracts.withColumn("_type", ct.payload_type())
        .withColumn("schemas", F.try_variant_get("doc", "$.components.schemas", "map<string,variant>"))
        .withColumn("s", F.expr("element_at(schemas, _type)"))
        .where(F.col("s").isNotNull() & _special())
        # A member has one schema only where no clause but one tells named members from the rest.
        .withColumn("flat", ~F.to_json(F.try_variant_get("doc", "$.components.schemas", "variant")).contains('"additionalProperties":{'))
    )
    none = "cast(NULL AS string)"
    ref, schema = (x.replace("_schemas", "schemas") for x in ct._resolve("s"))
    base = base.selectExpr("* EXCEPT (s)", f"{ref} AS ref", f"{schema} AS s")
    level = base.selectExpr(
        *keys, "schemas", "flat", "s", "array_compact(array(_type, ref)) AS stack", "'' AS clause", "'' AS path", "'' AS pointer",
        "ref IS NOT NULL AS extra",  # the field table does not follow a reference of the payload type itself
        "false AS cyclic", "false AS required", "false AS reached", "'root' AS kind", f"{none} AS composition", f"{none} AS parent", f"{none} AS at", "0 AS nested",
    )
    levels = []
    while True:
        level = level.selectExpr(
            "*", "try_variant_get(s, '$.patternProperties', 'variant') IS NOT NULL AS patterned",
            "try_variant_get(s, '$.properties', 'variant') IS NOT NULL AS named",
        )
        branches = [f"{ct._branches(k, 's', f'$.{k}')} AS _{k}" for k in ct.ALTERNATIVES]
        level = cut(level.selectExpr("*", *branches))
        levels.append(level)
        kids = level.where("NOT cyclic").selectExpr("*", f"explode({_kids()}) AS kid")
        if kids.isEmpty():
            break
        ref, schema = ct._resolve("kid.value")
        kids = kids.selectExpr("*", f"{ref.replace('_schemas', 'schemas')} AS ref", f"{schema.replace('_schemas', 'schemas')} AS target")
        joins = "kid.kind IN ('prop', 'item', 'rest') OR (kid.kind = 'allOf' AND flat)"
        kids = kids.selectExpr("*", f"({joins}) AS stays", f"{path_step_sql('kid.key')} AS step")
        inside = "concat(if(path = '', '', concat(path, '.')), {0})"
        # Elements of a referenced array, of an array's elements, and beside named members are not in the field table.
        plain_item = "kind = 'prop' AND NOT reached AND NOT named"
        level = kids.selectExpr(
            *keys, "schemas", "flat", "target AS s", "if(ref IS NULL, stack, array_append(stack, ref)) AS stack",
            "if(stays, clause, concat(pointer, '/', kid.kind, '/', kid.key)) AS clause",
            f"CASE kid.kind WHEN 'prop' THEN {inside.format('step')} WHEN 'rest' THEN {inside.format(chr(39) + '*' + chr(39))}"
            " WHEN 'item' THEN concat(path, '[]') ELSE if(stays, path, '') END AS path",
            "concat(pointer, CASE kid.kind WHEN 'prop' THEN concat('/properties/', step) WHEN 'item' THEN '/items'"
            " WHEN 'rest' THEN '/additionalProperties' WHEN 'not' THEN '/not/0' ELSE concat('/', kid.kind, '/', kid.key) END) AS pointer",
            f"extra OR kid.kind NOT IN ('prop', 'item') OR (kid.kind = 'item' AND NOT ({plain_item})) AS extra",
            "coalesce(array_contains(stack, ref), false) AS cyclic",
            "coalesce(kid.kind = 'prop' AND array_contains(try_variant_get(s, '$.required', 'array<string>'), kid.key), false) AS required",
            "ref IS NOT NULL AS reached", "kid.kind AS kind",
            "if(stays, NULL, concat(pointer, '/', kid.kind)) AS composition", "if(stays, NULL, clause) AS parent",
            "if(stays, NULL, path) AS at", "if(stays, nested, nested + 1) AS nested",
        )
    return reduce(DataFrame.unionByName, levels)


def contract_clauses(contracts: DataFrame, keys: tuple[str, ...] = ("name",)) -> Clauses | None:
    """The clauses of the contracts; None where the field table says all there is."""
    keys = list(keys)
    nodes = _nodes(contracts, keys)
    place = ["clause", "path", "pointer", "extra", "cyclic", "required", "composition", "parent", "at", "kind", "nested", "patterned"]
    refused = "coalesce(schema_of_variant(_s) = 'BOOLEAN' AND NOT try_variant_get(_s, '$', 'boolean'), false) AS refused"
    rest = f"coalesce(schema_of_variant(try_variant_get(_s, '$.additionalProperties', 'variant')) LIKE {_OBJECT} AND NOT patterned, false) AS rest"
    read = nodes.drop("_anyOf", "_oneOf").withColumnRenamed("s", "_s").selectExpr("*", refused, rest)
    table = cut(ct._keywords(read, [*keys, *place, "refused", "rest"]))
    if table.where("extra").isEmpty():
        return None
    # A schema of `false` admits no type at all.
    table = table.withColumn("typed", F.col("typed") | F.col("refused"))
    left_open = F.array_except("ungradable", F.array(*map(F.lit, ANSWERED)))
    roots = table.where("composition IS NOT NULL")
    found = roots.groupBy(*keys, "composition", "parent", "at", "kind").agg(
        F.sort_array(F.collect_list("clause")).alias("branches"), F.max("nested").alias("nested")
    )
    blind = table.where((F.size(left_open) > 0) | F.col("cyclic")).select(*keys, "pointer")
    inside = F.col("pointer").startswith(F.concat(F.col("composition"), F.lit("/")))
    blind = found.join(blind, keys).where(inside).select(*keys, "composition").distinct().withColumn("gradable", F.lit(False))
    found = found.join(blind, [*keys, "composition"], "left").fillna(True, ["gradable"])
    found = cut(found.withColumnRenamed("kind", "keyword"))
    # What stays ungraded: keywords nobody answers, and compositions that hold such a keyword.
    failed = found.where("NOT gradable").groupBy(*keys, F.col("parent").alias("clause"), F.col("at").alias("path")).agg(
        F.collect_set("keyword").alias("_blind")
    )
    rows = table.join(failed, [*keys, "clause", "path"], "left")
    kept = F.concat(left_open, F.coalesce("_blind", F.array().cast("array<string>")))
    rows = cut(rows.withColumn("ungradable", kept).drop("_blind", "refused"))
    names = F.map_from_entries(F.collect_list(F.struct("path", "declared_names")))
    wild = cut(rows.where("rest").groupBy(*keys, "clause").agg(names.alias("wild")))
    nesting = found.agg(F.coalesce(F.max("nested"), F.lit(0)).alias("n")).first()["n"]
    return Clauses(rows, found, wild, nesting)


def declared_beyond(clauses: Clauses, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Rows that hold always and that the field table lacks, as rows of a field table."""
    rows = clauses.rows.where("extra AND clause = ''")
    parent = F.regexp_replace("path", r"(\[\]|\.?[^.\[]+)$", "")
    leaf = F.regexp_extract("path", r"(\[\]|[^.\[]+)$", 1)
    return rows.select(
        *keys, "path", parent.alias("parent_path"), leaf.alias("leaf"), "required",
        F.size(F.regexp_extract_all("path", F.lit(r"\[\]|[^.\[]+"), 0)).alias("depth"), "cyclic", "pointer",
        *[c for c in v.CONSTRAINED if c != "cyclic"], "nullable",
    )


def one_a_path(rules: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Rules folded to what a path is declared as: the first types and the first list of values that any of its parts names."""
    named = F.struct((F.size("types") == 0).alias("a"), F.coalesce("pointer", F.lit("")).alias("b"))
    listed = F.struct(F.col("enum_json").isNull().alias("a"), F.coalesce("pointer", F.lit("")).alias("b"))
    return rules.groupBy(*keys, "path").agg(
        F.min("parent_path").alias("parent_path"), F.max("depth").alias("depth"), F.bool_or("required").alias("required"),
        F.min_by("types", named).alias("types"), F.min_by("enum_json", listed).alias("enum_json"),
    )


def with_wildcards(events: DataFrame, clauses: Clauses) -> DataFrame:
    """Events of a column `name` with the map `wild` of their contract, if any contract has one."""
    wild = clauses.wild.where("clause = ''").drop("clause")
    return events if wild.isEmpty() else events.join(broadcast_checked(wild), "name", "left")


def answered(fields: DataFrame, clauses: Clauses, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """The field table without the marks of what the clauses grade."""
    known = clauses.rows.where("clause = '' AND NOT extra").select(*keys, "path", F.col("ungradable").alias("_left"))
    return fields.join(known, [*keys, "path"], "left").withColumn("ungradable", F.coalesce("_left", "ungradable")).drop("_left")


def _digest(*parts: Column) -> Column:
    """A name for a value in its place."""
    return F.md5(F.concat_ws("\u0001", *[p.cast("string") for p in parts], F.md5(F.col("value_json").cast("binary"))).cast("binary"))


def composed_violations(obs: DataFrame, clauses: Clauses, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Broken compositions, one row per occurrence, shaped as `violations.violations` has them.

    `obs` is what that takes. Composed values are walked again, once for each branch; what is shuffled is a row for each value
    and branch and one for each thing in it that breaks. Where compositions are nested, these rows and the inner composed
    values are written, so that no walk is done twice.
    """
    keys = list(keys)
    table = clauses.rows.where("clause <> ''")
    # Parts of an `allOf` share a path; one row of a path stands for the value itself.
    main = F.row_number().over(W.partitionBy(*keys, "clause", "path").orderBy("pointer")) == 1
    rules = v.constrained_fields(table).select(*keys, "clause", "path", "pointer", main.alias("main"), *v.CONSTRAINED)
    rules = broadcast_checked(rules)
    known = clauses.compositions.where("gradable").withColumnRenamed("at", "path").withColumnRenamed("parent", "clause")
    inside = known.where("clause <> ''").groupBy(*keys, "clause", "path").agg(
        F.collect_list(F.struct("composition", "keyword", "branches")).alias("inner")
    )
    inside, wild = broadcast_checked(inside), broadcast_checked(clauses.wild)

    def broken(values: DataFrame, depth: int) -> DataFrame:
        """`keyword, n, held, times` of the `values` (`value, keyword, branches, held, value_json`) of which a composition is
        broken, with how often each occurs."""
        of = [*keys, "value", "keyword", "n", "held", "clause", "lead"]
        parts = values.select(
            *keys, "value", "keyword", F.size("branches").alias("n"), "held", F.col("branches")[0].alias("_first"),
            F.explode("branches").alias("clause"), F.parse_json("value_json").alias("detail"),
        ).withColumn("lead", F.col("clause") == F.col("_first"))
        parts = parts.join(wild, [*keys, "clause"], "left")
        walked = observe(parts, tuple(of), container_json=True, include_root=True, wild="wild")
        rows = v.with_facts(walked.join(rules, [*keys, "clause", "path"], "left"))
        breaks = (F.size(v.in_one(*v.value_checks())) > 0).alias("breaks")
        itself = ((F.col("path") == "") & F.coalesce("main", F.lit(True))).alias("itself")
        nested = depth < clauses.nesting
        if nested:
            rows = rows.join(inside, [*keys, "clause", "path"], "left")
        # The test sits in a generator: a filter would be pushed below the checks and do them twice.
        kept = F.filter(
            F.array(F.struct(breaks, itself)), lambda r: r["itself"] | r["breaks"] | (F.col("inner").isNotNull() if nested else F.lit(False))
        )
        rows = rows.select(*of, "path", "value_json", *(["inner"] if nested else []), F.inline(kept))
        if nested:
            rows = cut(rows.withColumn("value_json", F.when(F.col("inner").isNotNull(), F.col("value_json"))))
        marks = rows.select(
            "value", "keyword", "n", "held", F.when(F.col("breaks"), F.col("clause")).alias("failed"),
            (F.col("itself") & F.col("lead")).cast("long").alias("once"),
        )
        if nested:
            inner = rows.select(*keys, "value", "clause", "path", "value_json", F.inline("inner"))
            inner = inner.withColumn("held", F.struct(F.col("value").alias("outer"), "clause"))
            inner = inner.withColumn("value", _digest(F.col("value"), F.col("clause"), F.col("path"), F.col("composition")))
            failed = broken(inner, depth + 1).select(F.col("held.outer").alias("value"), F.col("held.clause").alias("failed"))
            marks = marks.unionByName(failed, allowMissingColumns=True)
        folded = marks.groupBy("value").agg(
            F.first("keyword", ignorenulls=True).alias("keyword"), F.first("n", ignorenulls=True).alias("n"),
            F.first("held", ignorenulls=True).alias("held"), F.size(F.collect_set("failed")).alias("failed"), F.sum("once").alias("times"),
        )
        bad = (
            F.when(F.col("keyword") == "anyOf", F.col("failed") == F.col("n"))
            .when(F.col("keyword") == "oneOf", F.col("n") - F.col("failed") != 1)
            .when(F.col("keyword") == "not", F.col("failed") == 0)
            .otherwise(F.col("failed") > 0)
        )
        return folded.where(bad)

    carried = [c for c in obs.columns if c not in ("path", "parent_path", "is_blank", "value_json")]
    container = F.col("type").isin("object", "array")
    top = obs.join(broadcast_checked(known.where("clause = ''").drop("clause")), [*keys, "path"])
    top = top.withColumns(
        {
            "held": F.struct(*carried, "path", "composition", F.when(~container, F.col("value_json")).alias("value_json")),
            "value": _digest(*[F.col(k) for k in keys], F.col("event_id"), F.col("path"), F.col("composition")),
        }
    )
    hit = broken(top, 1).select("keyword", "n", "held.*", F.explode(F.expr("sequence(1, times)")).alias("_time"))
    shown = F.coalesce(F.when(container, F.concat(F.lit("this "), "type")), F.col("value_json"))
    n = F.col("n").cast("string")
    says = (
        F.when(F.col("keyword") == "anyOf", F.concat(shown, F.lit(" fits none of the "), n, F.lit(" alternatives")))
        .when(F.col("keyword") == "oneOf", F.concat(shown, F.lit(" does not fit exactly one of the "), n, F.lit(" alternatives")))
        .when(F.col("keyword") == "not", F.concat(shown, F.lit(" is what the contract rules out")))
        .otherwise(F.concat(shown, F.lit(" does not fit all of the "), n, F.lit(" parts")))
    )
    return hit.select(
        *carried, "value_json", F.col("path").alias("at_path"), F.lit("other").alias("class"), "path",
        F.col("composition").alias("constraint"), F.col("keyword").alias("expected"), says.alias("message"),
    )
