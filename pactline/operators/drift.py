"""Where a profile and a contract disagree: six kinds of drift.

Inputs share a key (by default the contract `name`): `prof` from `observe.profile*`, `fields` from
`contracts.contract_fields`. Both hold one row per path, so every join here is contract-sized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions.names import repeats
from pactline.operators.observe import VALUE_CAP
from pactline.operators.ranking import top_n_per_group
from pactline.session import broadcast_checked

KEY = ("name",)


def _declared(fields: DataFrame, keys: list[str]) -> DataFrame:
    return fields.where("depth > 0").select(
        *keys, "path", "parent_path", "required", F.col("types").alias("declared_types"), "enum_json"
    )


def is_wild(path: Column) -> Column:
    """Paths through a wildcard: no contract names the members, so none can be missed."""
    return path.rlike(r"(^|\.)\*($|\.|\[)")


def _joined(prof: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    return prof.where("path <> ''").join(_declared(fields, keys).drop("parent_path"), [*keys, "path"])


def _carriers(prof: DataFrame, keys: list[str]) -> DataFrame:
    """Events whose value at a path is an object: the ones that could carry its members.

    For the payload itself that is every event, as a top-level field is measured against all.
    """
    return prof.select(
        *keys,
        F.col("path").alias("parent_path"),
        F.when(F.col("path") == "", F.col("seen_in")).otherwise(F.col("n_object")).alias("carriers"),
    )


def unexpected_types(seen: Column, declared: Column) -> Column:
    """Types a declaration does not admit; `integer` satisfies `number`."""
    extra = F.array_except(seen, declared)
    return F.when(F.array_contains(declared, "number"), F.array_remove(extra, "integer")).otherwise(extra)


def drift_undeclared(prof: DataFrame, fields: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Paths in the events that the contract does not declare, most frequent first."""
    declared = _declared(fields, list(keys)).select(*keys, "path")
    rows = prof.where("path <> ''").join(declared, [*keys, "path"], "left_anti")
    return rows.select(*keys, "path", "types", "seen_in").orderBy(*keys, F.desc("seen_in"), "path")


def drift_missing(prof: DataFrame, fields: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Required paths absent from events that carried their object, `seen_in = 0` included."""
    keys = list(keys)
    seen = prof.select(*keys, "path", "seen_in")
    return (
        _declared(fields, keys)
        .where("required")
        .join(_carriers(prof, keys), [*keys, "parent_path"])
        .join(seen, [*keys, "path"], "left")
        .fillna(0, ["seen_in"])
        .where("seen_in < carriers")
        .select(*keys, "path", "seen_in", "carriers", (F.col("carriers") - F.col("seen_in")).alias("absent_in"))
    )


def drift_unused(prof: DataFrame, fields: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Declared paths the events never held, unless `drift_missing` reports them."""
    keys = list(keys)
    graded = prof.select(*keys).distinct()
    return (
        _declared(fields, keys)
        .join(graded, keys, "left_semi")
        .join(prof.select(*keys, "path"), [*keys, "path"], "left_anti")
        .join(_carriers(prof, keys), [*keys, "parent_path"], "left")
        .where(~(F.col("required") & (F.coalesce("carriers", F.lit(0)) > 0)) & ~is_wild(F.col("path")))
        .select(*keys, "path", "required")
    )


def drift_types(prof: DataFrame, fields: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Declared paths holding a type the contract forbids, and the type set that would accept all.

    `mismatched_in` counts events, each once however many wrong types it holds.
    """
    declared = F.col("declared_types")
    wrong_in = F.aggregate(
        F.filter("type_sets", lambda s: F.size(unexpected_types(s["types"], declared)) > 0),
        F.lit(0).cast("bigint"),
        lambda acc, s: acc + s["n"],
    )
    observed = unexpected_types(F.col("types"), declared)
    still = F.filter(
        declared,
        lambda d: F.array_contains(F.col("types"), d)
        | ((d == "number") & F.array_contains(F.col("types"), "integer")),
    )
    return (
        _joined(prof, fields, list(keys))
        .where(F.size(declared) > 0)
        .withColumn("observed", observed)
        .where(F.size("observed") > 0)
        .select(
            *keys,
            "path",
            F.array_join(declared, " | ").alias("declared"),
            "observed",
            "seen_in",
            wrong_in.alias("mismatched_in"),
            F.concat(still, "observed").alias("suggested"),
        )
    )


def drift_blank(prof: DataFrame, fields: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Required paths that are present but blank in some events."""
    rows = _joined(prof, fields, list(keys)).where("required AND blank_in > 0")
    return rows.select(*keys, "path", "seen_in", F.col("blank_in").alias("empty_in"))


def drift_all(prof: DataFrame, fields: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """All drift of a profile but the enum kind, in one table: `kind, path` and the columns of each.

    One full outer join of profile and contract and one lookup of the carriers answer every kind, so
    a registry report plans two joins instead of one or two per kind.
    """
    keys = list(keys)
    graded = prof.where("path = ''").select(*keys).distinct()
    seen = prof.where("path <> ''").drop("parent_path").withColumn("_seen", F.lit(True))
    held = _declared(fields, keys).join(graded, keys, "left_semi").withColumn("_held", F.lit(True))
    both = seen.join(held, [*keys, "path"], "full_outer").join(_carriers(prof, keys), [*keys, "parent_path"], "left")
    c, declared = F.col, F.col("declared_types")
    is_seen, is_held = c("_seen").isNotNull(), c("_held").isNotNull()
    extra = F.when(F.size(declared) > 0, unexpected_types(c("types"), declared))
    absent = c("required") & (F.coalesce("seen_in", F.lit(0)) < F.coalesce("carriers", F.lit(0)))
    wrong_in = F.aggregate(
        F.filter("type_sets", lambda t: F.size(unexpected_types(t["types"], declared)) > 0),
        F.lit(0).cast("bigint"),
        lambda acc, t: acc + t["n"],
    )
    still = F.filter(
        declared,
        lambda t: F.array_contains(c("types"), t) | ((t == "number") & F.array_contains(c("types"), "integer")),
    )
    kinds = F.array_compact(
        F.array(
            F.when(is_seen & ~is_held, "undeclared"),
            F.when(is_seen & is_held & (F.size(extra) > 0), "wrongType"),
            F.when(is_held & absent, "missingRequired"),
            F.when(is_held & is_seen & c("required") & (c("blank_in") > 0), "emptyRequired"),
            F.when(is_held & ~is_seen & ~absent & ~is_wild(c("path")), "neverSeen"),
        )
    )
    return both.select(
        *keys, "path", F.explode(kinds).alias("kind"), "types", F.coalesce("seen_in", F.lit(0)).alias("seen_in"),
        F.col("required"), F.array_join(declared, " | ").alias("declared"), extra.alias("observed"),
        F.when(F.size(extra) > 0, wrong_in).alias("mismatched_in"), F.concat(still, extra).alias("suggested"),
        (F.coalesce("carriers", F.lit(0)) - F.coalesce("seen_in", F.lit(0))).alias("absent_in"),
        c("blank_in").alias("empty_in"),
    )


def enum_hits(obs: DataFrame, fields: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Occurrences of scalar values outside a declared enum. Whole JSON values; null never drifts."""
    declared = broadcast_checked(
        fields.where("depth > 0 AND enum_json IS NOT NULL").select(*keys, "path", "enum_json")
    )
    scalar = obs.where("type NOT IN ('object', 'array', 'null')")
    return scalar.join(declared, [*keys, "path"]).where("NOT array_contains(enum_json, value_json)")


def drift_enum(obs: DataFrame, fields: DataFrame, keys: tuple[str, ...] = KEY, listed: int = VALUE_CAP) -> DataFrame:
    """Per path: events carrying a value outside the enum, how many such values, the first `listed`.

    Counts are exact; `enum_values` has every value, whatever their number.
    """
    return enum_summary(enum_hits(obs, fields, keys), keys, listed)


def _by_event(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(path, value) counts; only paths that can repeat in an event keep it."""
    event = F.when(repeats(F.col("path")), F.col("event_id"))
    return hits.groupBy(*keys, "path", "value_json", event.alias("_event")).agg(F.count("*").alias("_n"))


def enum_values(hits: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Events per unexpected value: one row each, no cap."""
    return _by_event(hits, list(keys)).groupBy(*keys, "path", "value_json").agg(
        F.sum(F.when(F.col("_event").isNull(), F.col("_n")).otherwise(1)).cast("bigint").alias("events")
    )


def _listed(values: DataFrame, keys: list[str], listed: int) -> DataFrame:
    """Number of distinct values per path and the first `listed` of them; one input row per value."""
    number = values.groupBy(*keys, "path").agg(F.count("*").alias("distinct_unexpected"))
    shown = (
        top_n_per_group(values, [*keys, "path"], [F.asc("value_json")], listed, spread="value_json")
        .groupBy(*keys, "path")
        .agg(F.array_sort(F.collect_list("value_json")).alias("unexpected"))
    )
    return number.join(shown, [*keys, "path"])


def enum_summary(hits: DataFrame, keys: tuple[str, ...] = KEY, listed: int = VALUE_CAP) -> DataFrame:
    """`drift_enum` over rows already known to be outside their enum."""
    keys = list(keys)
    by_event = _by_event(hits, keys)
    carried = by_event.groupBy(*keys, "path", "_event").agg(F.sum("_n").alias("_n")).groupBy(*keys, "path").agg(
        F.sum(F.when(F.col("_event").isNull(), F.col("_n")).otherwise(1)).cast("bigint").alias("unexpected_in")
    )
    values = by_event.groupBy(*keys, "path", "value_json").agg(F.lit(1).alias("_one"))
    return carried.join(_listed(values, keys, listed), [*keys, "path"])


def enum_from_causes(caused: DataFrame, keys: tuple[str, ...] = KEY, listed: int = VALUE_CAP) -> DataFrame:
    """`drift_enum` out of `violations.causes`: a scalar outside its enum is a violation too."""
    keys = list(keys)
    rows = caused.where("value IS NOT NULL")
    carried = rows.groupBy(*keys, "path").agg(F.sum("affected").alias("unexpected_in"))
    values = rows.select(*keys, "path", F.col("value").alias("value_json"))
    return carried.join(_listed(values, keys, listed), [*keys, "path"])
