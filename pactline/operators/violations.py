"""Constraint violations of every event, their causes, and the verdict per event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.functions.formats import format_ok
from pactline.functions.json_types import json_text
from pactline.functions.names import path_step
from pactline.session import broadcast_checked

CONSTRAINED = (
    "typed", "types", "enum_json", "const_json", "format", "pattern", "min_len", "max_len", "minimum", "maximum",
    "above", "below", "multiple_of", "min_items", "max_items", "unique_items", "closed", "required_names",
    "declared_names", "min_props", "max_props", "any_of", "one_of", "ungradable", "cyclic",
)
# Class of the rows that mark a value under a constraint nobody graded.
UNGRADED = "ungraded"


def constrained_fields(fields: DataFrame) -> DataFrame:
    """Field rows that can reject a value; the rest never reach the join."""
    return fields.where(
        "typed OR enum_json IS NOT NULL OR const_json IS NOT NULL OR format IS NOT NULL OR pattern IS NOT NULL"
        " OR min_len IS NOT NULL OR max_len IS NOT NULL OR minimum IS NOT NULL OR maximum IS NOT NULL"
        " OR above IS NOT NULL OR below IS NOT NULL OR multiple_of IS NOT NULL OR min_items IS NOT NULL"
        " OR max_items IS NOT NULL OR unique_items OR closed OR size(required_names) > 0"
        " OR min_props IS NOT NULL OR max_props IS NOT NULL OR any_of IS NOT NULL OR one_of IS NOT NULL"
        " OR size(ungradable) > 0 OR cyclic"
    )


def constraint_pointer(path: Column, keyword: Column | str) -> Column:
    """Where in the contract the failed check stands, such as `/properties/ssn/pattern`."""
    # Steps of a wildcard first, behind a mark that no name holds.
    steps = F.regexp_replace(F.replace(path, F.lit("[]"), F.lit("\u0001items")), r"(^|\.)\*", "\u0001additionalProperties")
    head = F.replace(F.regexp_replace(steps, "(^|\\.)(?=[^\u0001])", "/properties/"), F.lit("\u0001"), F.lit("/"))
    return F.concat(head, F.lit("/"), F.lit(keyword) if isinstance(keyword, str) else keyword)


def pointer_of(fields: DataFrame) -> Column:
    """Where a rule stands in its contract, if the table says so; else its path tells."""
    return F.col("pointer") if "pointer" in fields.columns else F.lit(None).cast("string").alias("pointer")


def in_one(*arrays: Column) -> Column:
    """The arrays one after the other. Where expressions are interpreted, as below `inline`, `concat` builds a lazy list a row."""
    return F.flatten(F.array(*arrays))


def _any_set(*constraints: str) -> Column:
    return reduce(Column.__or__, [F.col(c).isNotNull() for c in constraints])


def with_facts(joined: DataFrame) -> DataFrame:
    """Observations joined with `CONSTRAINED`, with what several checks read of the JSON text: `_text`, `_members`, `_length`.

    Each is read once, and only where the rule of the path asks for it.
    """
    value, kind = F.col("value_json"), F.col("type")
    asks = F.coalesce(F.size("required_names") > 0, F.lit(False)) | F.coalesce("closed", F.lit(False)) | _any_set("min_props", "max_props")
    return joined.withColumns(
        {
            "_text": F.when((kind == "string") & _any_set("min_len", "max_len", "pattern", "format"), json_text(value)),
            "_members": F.when((kind == "object") & asks, F.json_object_keys(value)),
            "_length": F.when((kind == "array") & _any_set("min_items", "max_items"), F.json_array_length(value)),
        }
    )


def value_checks(members_too: bool = True) -> list[Column]:
    """Arrays of violation structs; empty where the value passes.

    Columns: those of an observation, `CONSTRAINED`, `pointer` and those of `with_facts`. `members_too` adds absent required members; per-event grading decides on those itself.
    These expressions are interpreted row by row, so every check asks first whether the rule has the constraint, and checks
    for one kind of value are asked for together.
    """
    c = F.col
    value, kind = c("value_json"), c("type")
    is_number = kind.isin("integer", "number")
    is_container = kind.isin("object", "array")
    text, members, length = c("_text"), c("_members"), c("_length")
    number = F.when(is_number, value.cast("double"))
    shape = "array<struct<class:string,path:string,constraint:string,expected:string,message:string>>"

    def row(cls: str, path: Column, constraint: Column, expected: str, message: Column) -> Column:
        return F.struct(
            F.lit(cls).alias("class"), path.alias("path"), constraint.alias("constraint"),
            F.lit(expected).alias("expected"), message.alias("message"),
        )

    def one(cond: Column, cls: str, keyword: str, message: Column) -> Column:
        at = F.coalesce(F.concat(c("pointer"), F.lit(f"/{keyword}")), constraint_pointer(c("path"), keyword))
        constraint = at if cls == "other" else F.lit(cls)
        hit = F.array(row(cls, c("path"), constraint, keyword, message))
        return F.when(F.coalesce(cond, F.lit(False)), hit).otherwise(F.array().cast(shape))

    # Containers are described, not quoted.
    quoted = F.when(is_container, F.concat(F.lit("this "), kind)).otherwise(value)

    def says(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def child(name: Column) -> Column:
        return F.when(c("path") == "", path_step(name)).otherwise(F.concat(c("path"), F.lit("."), path_step(name)))

    def admitted(types: str) -> Column:
        return (
            F.array_contains(types, kind)
            | ((kind == "integer") & F.array_contains(types, "number"))
            | ((kind == "number") & F.array_contains(types, "integer") & (number == F.floor(number)))
        )

    def alternatives(types: str, keyword: str) -> Column:
        return one(
            c(types).isNotNull() & ~admitted(types), "other", keyword,
            says(quoted, " is none of ", F.array_join(types, ", ")),
        )

    items = F.expr("transform(try_variant_get(try_parse_json(if(type = 'array', value_json, NULL)), '$', 'array<variant>'), x -> to_json(x))")
    ratio = number / c("multiple_of")
    missing = F.transform(
        F.array_except(F.when(members.isNotNull(), c("required_names")), members),
        lambda n: row("missingRequired", child(n), F.lit("missingRequired"), "required", says('"', n, '" is a required property')),
    )
    extra = F.when(
        c("closed"),
        F.transform(
            F.array_except(members, c("declared_names")),
            lambda n: row(
                "undeclared", child(n), F.lit("undeclared"), "additionalProperties",
                says("Additional properties are not allowed ('", n, "' was unexpected)"),
            ),
        ),
    )
    empty = F.array().cast(shape)

    def limit(keyword: str, name: str, broken: Column, message: Column) -> Column:
        return one(c(name).isNotNull() & broken, "other", keyword, message)

    def together(cond: Column, *checks: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), in_one(*checks)).otherwise(empty)

    return [
        one(
            c("typed") & ~admitted("types"), "wrongType", "type",
            says(quoted, " is not of type ", F.array_join("types", ", ")),
        ),
        together(
            _any_set("enum_json", "const_json"),
            one(
                (c("enum_json").isNotNull() & ~F.array_contains("enum_json", value)), "outsideEnum", "enum",
                says(quoted, " is not one of [", F.array_join("enum_json", ", "), "]"),
            ),
            one(c("const_json").isNotNull() & (value != c("const_json")), "outsideEnum", "const", says(c("const_json"), " was expected")),
        ),
        together(
            members.isNotNull(),
            *([F.coalesce(missing.cast(shape), empty)] if members_too else []),
            F.coalesce(extra.cast(shape), empty),
            limit("minProperties", "min_props", F.size(members) < c("min_props"), says(quoted, " has less than ", c("min_props").cast("string"), " members")),
            limit("maxProperties", "max_props", F.size(members) > c("max_props"), says(quoted, " has more than ", c("max_props").cast("string"), " members")),
        ),
        together(
            text.isNotNull() & _any_set("min_len", "max_len", "pattern"),
            limit("minLength", "min_len", F.length(text) < c("min_len"), says(quoted, " is shorter than ", c("min_len").cast("string"), " characters")),
            limit("maxLength", "max_len", F.length(text) > c("max_len"), says(quoted, " is longer than ", c("max_len").cast("string"), " characters")),
            limit("pattern", "pattern", ~F.rlike(text, F.regexp_replace("pattern", r"(?<!\\)\$$", r"\\z")), says(quoted, ' does not match "', c("pattern"), '"')),
        ),
        limit("format", "format", ~format_ok(c("format"), text), says(quoted, ' is not a "', c("format"), '"')),
        together(
            is_number & _any_set("minimum", "maximum", "above", "below", "multiple_of"),
            limit("minimum", "minimum", number < c("minimum"), says(quoted, " is less than the minimum of ", c("minimum").cast("string"))),
            limit("maximum", "maximum", number > c("maximum"), says(quoted, " is greater than the maximum of ", c("maximum").cast("string"))),
            limit("exclusiveMinimum", "above", number <= c("above"), says(quoted, " is not above ", c("above").cast("string"))),
            limit("exclusiveMaximum", "below", number >= c("below"), says(quoted, " is not below ", c("below").cast("string"))),
            limit("multipleOf", "multiple_of", F.abs(ratio - F.round(ratio)) > 1e-9, says(quoted, " is not a multiple of ", c("multiple_of").cast("string"))),
        ),
        together(
            (kind == "array") & (_any_set("min_items", "max_items") | c("unique_items")),
            limit("minItems", "min_items", length < c("min_items"), says(quoted, " has less than ", c("min_items").cast("string"), " items")),
            limit("maxItems", "max_items", length > c("max_items"), says(quoted, " has more than ", c("max_items").cast("string"), " items")),
            one(c("unique_items") & (F.size(items) != F.size(F.array_distinct(items))), "other", "uniqueItems", says(quoted, " has non-unique elements")),
        ),
        together(_any_set("any_of", "one_of"), alternatives("any_of", "anyOf"), alternatives("one_of", "oneOf")),
    ]


def _ungraded_mark() -> Column:
    """A row for a value whose declaration holds a constraint that is not graded, or stops at a cycle."""
    held = (F.size("ungradable") > 0) | (F.col("cyclic") & (F.col("type") == "object"))
    mark = F.struct(
        F.lit(UNGRADED).alias("class"), F.col("path").alias("path"), F.lit(UNGRADED).alias("constraint"),
        F.lit(UNGRADED).alias("expected"), F.lit("not graded").alias("message"),
    )
    return F.when(held, F.array(mark)).otherwise(F.array())


def violations(
    obs: DataFrame, fields: DataFrame, keys: tuple[str, ...] = ("name",), mark_ungraded: bool = False
) -> DataFrame:
    """One row per broken constraint and occurrence; with `mark_ungraded` also one per value nobody could grade.

    `obs` comes from `observe(..., container_json=True, include_root=True)`. The contract side is
    broadcast after a size check; the observations are never shuffled. Keywords that a path table
    cannot carry are listed in `ungradable` of the field table and reported, not passed silently: the marks make the
    events that hold such a value `undecided` in `verdicts`.
    """
    keys = list(keys)
    rules = broadcast_checked(constrained_fields(fields).select(*keys, "path", pointer_of(fields), *CONSTRAINED))
    joined = with_facts(obs.join(rules, [*keys, "path"]))
    # A container is not carried as evidence: it can be the whole payload.
    evidence = F.when(~F.col("type").isin("object", "array"), F.col("value_json")).alias("value_json")
    carried = [c for c in obs.columns if c not in ("path", "parent_path", "is_blank", "value_json")]
    checks = value_checks() + ([_ungraded_mark()] if mark_ungraded else [])
    return joined.select(*carried, evidence, F.col("path").alias("at_path"), F.inline(in_one(*checks)))


def format_violations(obs: DataFrame, fields: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Strings that do not conform to their declared format."""
    rules = broadcast_checked(fields.where("format IS NOT NULL").select(*keys, "path", "format"))
    strings = obs.where("type = 'string'").join(rules, [*keys, "path"])
    return strings.where(~format_ok(F.col("format"), json_text(F.col("value_json"))))


def causes(viol: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Everything a report needs from the violations, in one shuffle of the rejected rows.

    The rows meet once by event; flags mark the first row of each event, of each cause in it and of
    each value in that, so all later counts are sums with map-side partials and no key is hot. One
    row per (cause, unexpected enum value): `affected` events, `occurrences`, `rejected` (events
    counted under this cause), `value_events`, and the first example. Marks of class `ungraded` count an event only
    where nothing in it broke, so their `rejected` is the number of undecided events.
    """
    keys = list(keys)
    cause = [*keys, "class", "path", "constraint"]
    scalar_enum = (F.col("class") == "outsideEnum") & (F.col("expected") != "const") & ~F.col("type").isin("object", "array", "null")
    rows = viol.withColumn("value", F.when(scalar_enum, F.col("value_json")))

    def first(*parts):
        order = W.partitionBy(*keys, "event_id", *parts).orderBy(F.col("class") == UNGRADED, "class", "path", "constraint", "value")
        return (F.row_number().over(order) == 1)

    marked = rows.withColumns(
        {
            "_event": first(),
            "_cause": first("class", "path", "constraint"),
            "_value": first("class", "path", "constraint", "value"),
        }
    )
    return marked.groupBy(*cause, "value").agg(
        F.count_if("_cause").alias("affected"),
        F.count("*").alias("occurrences"),
        F.count_if("_event").alias("rejected"),
        F.count_if(F.col("_value") & F.col("value").isNotNull()).alias("value_events"),
        F.min(F.struct("ts", "event_id")).alias("_at"),
        F.min_by(F.struct("value_json", "message"), F.struct("ts", "event_id")).alias("_first"),
        # Also keeps the aggregate hash-based.
        F.collect_set("type").alias("_types"),
    )


def group_failures(caused: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """One row per cause: `affected` events, `occurrences`, and the first example with its message."""
    cause = [*keys, "class", "path", "constraint"]
    out = caused.where(F.col("class") != UNGRADED).groupBy(*cause).agg(
        F.sum("affected").alias("affected"),
        F.sum("occurrences").alias("occurrences"),
        F.min_by("_first", "_at").alias("_first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_types")))).alias("value_types"),
    )
    return out.select(
        *cause, "affected", "occurrences", "value_types",
        F.col("_first.value_json").alias("example"), F.col("_first.message").alias("message"),
    )


def failed_events(caused: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Rejected events per key, and those that hold an ungraded value but break nothing."""
    mark = F.col("class") == UNGRADED
    return caused.groupBy(*keys).agg(
        F.sum(F.when(mark, 0).otherwise(F.col("rejected"))).cast("bigint").alias("failed"),
        F.sum(F.when(mark, F.col("rejected")).otherwise(0)).cast("bigint").alias("undecided"),
    )


def verdicts(sampled: DataFrame, caused: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Sampled, passed, failed and undecided events; `sampled` holds the event count per key."""
    return (
        sampled.join(failed_events(caused, keys), list(keys), "left")
        .fillna(0, ["failed", "undecided"])
        .withColumn("passed", F.col("sampled") - F.col("failed") - F.col("undecided"))
        .select(*keys, "sampled", "passed", "failed", "undecided")
    )
