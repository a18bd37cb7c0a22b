"""Repairs applied to the field table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.functions.names import member_name
from pactline.operators.observe import VALUE_CAP


def apply_repairs(
    fields: DataFrame, repairs: DataFrame, keys: tuple[str, ...] = ("name",), enum_values: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Edited fields, and the repairs refused with the reason.

    `repairs` has one `(path, fix)` per key and field and kind. Refused: an array element, a path the
    contract cannot place, a field that is already optional, a field declared by a reference (its type is shared and
    is to be changed itself). Editing a member of a shared type edits every path that reaches it; what several paths
    ask of one member is joined. `enum_values` (`path, value_json`, one row per value) has the values of an `extendEnum`:
    what a fix lists is cut for display, so a list that may be cut is refused without that table.
    """
    keys = list(keys)
    asked = repairs.where("fix IS NOT NULL")
    owners = fields.select(*keys, "path", "owner_type", "leaf", "required", "ref_target", F.lit(True).alias("_declared"))
    if enum_values is not None:
        seen = enum_values.groupBy(*keys, "path").agg(F.array_sort(F.collect_set("value_json")).alias("_all"))
        asked = asked.join(seen, [*keys, "path"], "left").withColumn(
            "fix", F.when(F.col("fix.kind") == "extendEnum", F.col("fix").withField("values", F.coalesce("_all", "fix.values"))).otherwise(F.col("fix"))
        ).drop("_all")
    placed = asked.join(owners, [*keys, "path"], "left")
    parents = fields.select(
        *keys, F.col("path").alias("_parent"), F.coalesce("ref_target", "owner_type").alias("_parent_type"),
        F.col("depth").alias("_parent_depth"),
    )
    parent = F.when(F.col("path").contains("."), F.regexp_replace("path", r"\.[^.]*$", "")).otherwise("")
    placed = placed.withColumn("_parent", parent).join(parents, [*keys, "_parent"], "left")
    kind = F.col("fix.kind")
    reason = (
        F.when((F.col("path") == "") | F.col("path").endswith("[]"), "not a named property")
        .when((kind == "declareField") & F.col("_parent_type").isNull(), "no type owns this path")
        .when((kind == "declareField") & F.col("_declared"), "already declared")
        .when((kind != "declareField") & F.col("_declared").isNull(), "not declared")
        .when((kind == "dropRequired") & ~F.col("required"), "already optional")
        .when(~kind.isin("dropRequired", "declareField") & F.col("ref_target").isNotNull(), "declared by a reference")
        .when((kind == "extendEnum") & F.lit(enum_values is None) & (F.size("fix.values") >= VALUE_CAP), "values may be cut")
    )
    judged = placed.withColumn("reason", reason)
    refused = judged.where("reason IS NOT NULL").select(*keys, "path", kind.alias("kind"), "reason")
    ok = judged.where("reason IS NULL")
    # One row of edits per owning type and member.
    edits = (
        ok.where(kind != "declareField")
        .groupBy(*keys, "owner_type", "leaf")
        .agg(
            F.bool_or(kind == "dropRequired").alias("_optional"),
            F.bool_or(kind == "requireNonEmpty").alias("_nonempty"),
            # The declared order stays in front; types beyond it follow by name.
            F.max(F.when(kind == "widenType", F.struct(F.size("fix.types").alias("n"), F.col("fix.types").alias("t")))).getField("t").alias("_first"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(kind == "widenType", F.col("fix.types")))))).alias("_more"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(kind == "extendEnum", F.col("fix.values")))))).alias("_listed"),
            F.array_sort(F.collect_set(F.when(kind == "constrainPattern", F.col("fix.pattern")))).alias("_patterns"),
        )
        .withColumns(
            {
                "_types": F.array_union("_first", "_more"),
                "_values": F.when(F.size("_listed") > 0, F.col("_listed")),
                # Shapes of several paths: any of them.
                "_pattern": F.when(F.size("_patterns") == 1, F.get("_patterns", F.lit(0))).when(
                    F.size("_patterns") > 1, F.concat(F.lit("(?:"), F.array_join("_patterns", ")|(?:"), F.lit(")"))
                ),
            }
        )
        .drop("_first", "_more", "_listed", "_patterns")
    )
    c = F.col
    no_object = c("_types").isNotNull() & ~F.array_contains("_types", "object")
    no_array = c("_types").isNotNull() & ~F.array_contains("_types", "array")
    names = F.array().cast("array<string>")
    edited = fields.join(edits, [*keys, "owner_type", "leaf"], "left").withColumns(
        {
            "required": c("required") & ~F.coalesce("_optional", F.lit(False)),
            "min_len": F.when(c("_nonempty"), F.greatest(F.coalesce("min_len", F.lit(0)), F.lit(1))).otherwise(c("min_len")),
            "nullable": F.when(c("_types").isNotNull(), F.array_contains("_types", "null")).otherwise(c("nullable")),
            "enum_json": F.when(
                c("_values").isNotNull(), F.array_union(F.coalesce("enum_json", names), "_values")
            ).otherwise(c("enum_json")),
            "format": F.when(c("_pattern").isNull(), c("format")),
            "pattern": F.coalesce("_pattern", "pattern"),
            "closed": F.when(no_object, False).otherwise(c("closed")),
            "required_names": F.when(no_object, names).otherwise(c("required_names")),
            "declared_names": F.when(no_object, names).otherwise(c("declared_names")),
            "min_items": F.when(~no_array | no_array.isNull(), c("min_items")),
            "max_items": F.when(~no_array | no_array.isNull(), c("max_items")),
            "unique_items": c("unique_items") & ~F.coalesce(no_array, F.lit(False)),
            "min_props": F.when(~no_object | no_object.isNull(), c("min_props")),
            "max_props": F.when(~no_object | no_object.isNull(), c("max_props")),
            "any_of": F.when(c("_types").isNull(), c("any_of")),
            "one_of": F.when(c("_types").isNull(), c("one_of")),
            # Types last: the conditions above read the old table.
            "typed": c("typed") | c("_types").isNotNull() | c("_pattern").isNotNull(),
            "types": F.coalesce(
                "_types",
                F.when(c("_pattern").isNotNull() & (F.size("types") == 0), F.array(F.lit("string"))),
                "types",
            ),
        }
    )
    # An object re-declared as something else loses what was declared below it.
    gone = edited.where(no_object & (c("depth") > 0)).select(*keys, c("path").alias("_gone"))
    below = fields.select(*keys, "path", F.explode(_parents_of("path")).alias("_gone")).join(gone, [*keys, "_gone"])
    dropped = below.select(*keys, "path").distinct()
    optional = ok.where(kind == "dropRequired").groupBy(*keys, F.col("owner_type").alias("_owner")).agg(
        F.collect_set("leaf").alias("_dropped")
    )
    added = ok.where(kind == "declareField").groupBy(*keys, F.col("_parent_type").alias("_owner")).agg(
        F.collect_set(member_name(F.regexp_extract("path", r"([^.]*)$", 1))).alias("_added")
    )
    edited = edited.withColumn("_owner", F.coalesce("ref_target", F.when(c("depth") == 0, c("owner_type"))))
    edited = edited.withColumn(
        "_owner", F.coalesce("_owner", F.when(F.size("declared_names") > 0, c("owner_type")))
    )
    out = (
        edited.join(dropped, [*keys, "path"], "left_anti")
        .join(optional, [*keys, "_owner"], "left")
        .join(added, [*keys, "_owner"], "left")
        .withColumns(
            {
                "required_names": F.array_except("required_names", F.coalesce("_dropped", names)),
                "declared_names": F.array_union("declared_names", F.coalesce("_added", names)),
            }
        )
        .select(fields.columns)
    )
    new = ok.where(kind == "declareField").select(
        *keys,
        "path",
        c("_parent").alias("parent_path"),
        member_name(F.regexp_extract("path", r"([^.]*)$", 1)).alias("leaf"),
        c("_parent_type").alias("owner_type"),
        (c("_parent_depth") + 1).alias("depth"),
        c("fix.types").alias("types"),
        F.array_contains("fix.types", "null").alias("nullable"),
        (F.size("fix.types") > 0).alias("typed"),
    )
    for name, dtype in fields.dtypes:
        if name not in new.columns:
            value = F.array() if dtype.startswith("array") and name not in ("enum_json", "any_of", "one_of") else F.lit(False if dtype == "boolean" else None)
            new = new.withColumn(name, value.cast(dtype))
    version = [k for k in fields.columns if k == "version" and k not in keys]
    if version:
        held = fields.groupBy(*keys).agg(F.max("version").alias("version"))
        new = new.drop("version").join(held, keys)
    return out.unionByName(new.select(fields.columns)), refused


def _parents_of(path: str):
    from pactline.operators.infer import _ancestors

    return _ancestors(F.col(path))
