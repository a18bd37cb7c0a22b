"""Drift and violations fused to one ranked list of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.functions.names import event_key
from pactline.functions.text import clip, field_label, percent
from pactline.operators.ranking import top_n_per_group
from pactline.operators.shape import common_pattern

# Issue kinds in the order they are listed, and severities, worst first.
KINDS = (
    "wrongType", "outsideEnum", "missingRequired", "emptyRequired", "undeclared", "neverSeen", "rejected",
    "unregistered", "concern",
)
SEVERITIES = ("error", "warning", "info")
LISTED_SIBLINGS = 32
MAX_EXAMPLES = 10
EVENTS_PER_ISSUE = 25

FIX_TYPE = "struct<kind:string,types:array<string>,values:array<string>,pattern:string>"


def severity_rank(col: str = "severity") -> Column:
    """0 for the worst."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(col)).cast("int") - 1


def kind_rank(col: str = "kind") -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(col)).cast("int") - 1


def severity_floor(kind: Column, rejects: Column) -> Column:
    """Rejecting is an error, a field never seen is a note, anything else a warning."""
    return F.when(rejects, "error").when(kind == "neverSeen", "info").otherwise("warning")


def _fix(kind: str, types: Column | None = None, values: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        (types if types is not None else F.lit(None)).cast("array<string>").alias("types"),
        (values if values is not None else F.lit(None)).cast("array<string>").alias("values"),
        F.lit(None).cast("string").alias("pattern"),
    ).cast(FIX_TYPE)


def _shape(df: DataFrame, keys: list[str], kind: str, affected, declared, observed, detail, fix) -> DataFrame:
    """A drift frame in the common form: `stat` is the count its wording speaks of."""
    return df.select(
        *keys,
        F.lit(kind).alias("kind"),
        "path",
        F.col(affected).cast("bigint").alias("stat") if affected else F.lit(0).cast("bigint").alias("stat"),
        declared.cast("string").alias("declared"),
        observed.cast("string").alias("observed"),
        detail.cast("string").alias("detail"),
        (fix if fix is not None else F.lit(None).cast(FIX_TYPE)).alias("fix"),
    )


def drift_rows(drift: dict[str, DataFrame], keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """The six drift frames (`undeclared, unused, types, enum, missing, blank`) in one table."""
    keys, c, none = list(keys), F.col, F.lit(None)
    types, enum, missing = drift["types"], drift["enum"], drift["missing"]
    seen = F.concat(F.lit("present in "), c("seen_in").cast("string"))
    required = F.when(c("required"), "required").otherwise("optional")
    parts = [
        _shape(types, keys, "wrongType", "mismatched_in", c("declared"), F.array_join("observed", " | "), none, _fix("widenType", c("suggested"))),
        _enum_rows(enum, keys),
        _shape(missing, keys, "missingRequired", "absent_in", F.lit("required"), seen, none, _fix("dropRequired")),
        _shape(drift["blank"], keys, "emptyRequired", "empty_in", F.lit("required"), F.concat(F.lit("blank in "), c("empty_in").cast("string")), none, _fix("requireNonEmpty")),
        _shape(drift["undeclared"], keys, "undeclared", "seen_in", none, F.array_join("types", " | "), none, _fix("declareField", c("types"))),
        _shape(drift["unused"], keys, "neverSeen", None, required, none, none, None),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drift_rows_from(table: DataFrame, enum: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """`drift_rows` out of `drift.drift_all` and the enum drift."""
    keys, c, none = list(keys), F.col, F.lit(None)
    kind = c("kind")

    def by_kind(**cases):
        out = F
        for name, value in cases.items():
            out = out.when(kind == name, value)
        return out

    num = F.lit(0).cast("bigint")
    text = F.concat(F.lit("blank in "), c("empty_in").cast("string"))
    rows = table.select(
        *keys, "kind", "path",
        F.coalesce(
            by_kind(wrongType=c("mismatched_in"), missingRequired=c("absent_in"), emptyRequired=c("empty_in"), undeclared=c("seen_in")), num
        ).cast("bigint").alias("stat"),
        by_kind(
            wrongType=c("declared"), missingRequired=F.lit("required"), emptyRequired=F.lit("required"),
            neverSeen=F.when(c("required"), "required").otherwise("optional"),
        ).cast("string").alias("declared"),
        by_kind(
            wrongType=F.array_join("observed", " | "), missingRequired=F.concat(F.lit("present in "), c("seen_in").cast("string")),
            emptyRequired=text, undeclared=F.array_join("types", " | "),
        ).cast("string").alias("observed"),
        none.cast("string").alias("detail"),
        by_kind(
            wrongType=_fix("widenType", c("suggested")), missingRequired=_fix("dropRequired"),
            emptyRequired=_fix("requireNonEmpty"), undeclared=_fix("declareField", c("types")),
        ).cast(FIX_TYPE).alias("fix"),
    )
    return rows.unionByName(_enum_rows(enum, keys))


def _enum_rows(enum: DataFrame, keys: list[str]) -> DataFrame:
    values = F.array_join(F.transform("unexpected", lambda v: F.concat(F.lit("`"), v, F.lit("`"))), ", ")
    none = F.lit(None)
    return _shape(enum, keys, "outsideEnum", "unexpected_in", none, values, none, _fix("extendEnum", values=F.col("unexpected")))


def issues(
    drift: DataFrame, failures: DataFrame, sampled: DataFrame, keys: tuple[str, ...] = ("name",)
) -> DataFrame:
    """Each disagreement once: drift joined to the failure that explains it, leftovers as `rejected`.

    `drift` from `drift_rows`, `failures` from `group_failures`, `sampled` with the events per key.
    The key of an issue means the same on any sample.
    """
    keys = list(keys)
    named = failures.where("class <> 'other'").select(
        *keys, F.col("class").alias("kind"), "path",
        F.col("affected").alias("failed_in"), "message", F.col("example").alias("failed_example"),
    )
    named = top_n_per_group(named, [*keys, "kind", "path"], [F.desc("failed_in"), F.asc("message")], 1)
    found = drift.join(named, [*keys, "kind", "path"], "left").withColumn("rejects", F.col("failed_in").isNotNull())
    # Blank fields satisfy the contract, so no failure can belong to them.
    found = found.withColumns(
        {
            "affected": F.when(
                F.col("rejects") & ~F.col("kind").isin("undeclared"), F.col("failed_in")
            ).otherwise(F.col("stat")),
            "constraint": F.lit(None).cast("string"),
            "example": F.col("failed_example"),
        }
    )
    explained = drift.select(*keys, F.col("kind").alias("class"), "path").distinct()
    left = failures.join(explained, [*keys, "class", "path"], "left_anti").select(
        *keys, F.lit("rejected").alias("kind"), "path", F.col("affected").alias("stat"),
        F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("observed"),
        F.lit(None).cast("string").alias("detail"), F.lit(None).cast(FIX_TYPE).alias("fix"),
        "message", F.lit(True).alias("rejects"), "affected", "constraint", "example",
    )
    both = found.select(left.columns).unionByName(left).join(sampled.select(*keys, "sampled"), keys)
    return issue_text(
        both.withColumns(
            {
                "key": F.when(
                    F.col("kind") == "rejected", F.concat_ws(":", "kind", "path", "constraint")
                ).otherwise(F.concat_ws(":", "kind", "path")),
                "severity": severity_floor(F.col("kind"), F.col("rejects")),
                # Only a named property can be edited.
                "fix": F.when((F.col("path") != "") & ~F.col("path").endswith("[]"), F.col("fix")),
            }
        )
    )


def issue_text(df: DataFrame) -> DataFrame:
    """Add `summary` and `action`, one line each."""
    c, lit = F.col, F.lit
    field = field_label(c("path"))
    share_stat, share = percent(c("stat"), c("sampled")), percent(c("affected"), c("sampled"))
    summary = (
        F.when(c("kind") == "wrongType", F.concat(lit("type of "), field, lit(": contract "), c("declared"), lit(", traffic "), c("observed"), lit(" in "), share_stat))
        .when(c("kind") == "outsideEnum", F.concat(lit("values of "), field, lit(" beyond its list: "), c("observed")))
        .when(c("kind") == "missingRequired", F.concat(lit("mandatory "), field, lit(" left out: "), share))
        .when(c("kind") == "emptyRequired", F.concat(lit("mandatory "), field, lit(" empty: "), share))
        .when(c("kind") == "undeclared", F.concat(lit("unknown field "), field, lit(": "), share))
        .when(c("kind") == "neverSeen", F.concat(lit("no traffic for "), field))
        .otherwise(F.concat(lit("constraint on "), field, lit(" broken: "), share, lit(" ("), clip(c("message")), lit(")")))
    )
    action = (
        F.when(c("kind") == "wrongType", F.concat(lit("Agree on one type: "), c("declared"), lit(" in the producer, or "), c("observed"), lit(" in the contract.")))
        .when(c("kind") == "outsideEnum", lit("Extend the list, or stop sending these values."))
        .when(c("kind") == "missingRequired", F.concat(lit("Send "), field, lit(" always, or drop it from the mandatory fields.")))
        .when(c("kind") == "emptyRequired", F.concat(lit("Fill "), field, lit(" at the source, or set a least length.")))
        .when((c("kind") == "undeclared") & c("rejects"), F.concat(lit("Closed object: add "), field, lit(" to it, or its events stay invalid.")))
        .when(c("kind") == "undeclared", F.concat(lit("Describe "), field, lit(" ("), c("observed"), lit(") so that it is checked.")))
        .when(c("kind") == "neverSeen", lit("Look at a longer span; then retire the field."))
        .otherwise(lit("Loosen the constraint, or correct the source."))
    )
    return df.withColumns({"summary": summary, "action": action})


def _rank_order() -> list[Column]:
    return [severity_rank(), F.desc("affected"), F.asc("path"), kind_rank(), F.asc("key")]


def rank_issues(iss: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Add `rank` per key: severity, then events affected, then path. Issues are contract-sized."""
    return iss.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*_rank_order())))


def headline(iss: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """The first issue's summary per key."""
    best = top_n_per_group(iss, list(keys), _rank_order(), 1)
    return best.select(*keys, F.col("summary").alias("headline"), F.col("kind").alias("headline_kind"))


def suggest_repairs(iss: DataFrame, obs: DataFrame | None = None, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Fill `fix` for rejections about the spelling of a string: the shape all strings there share."""
    if obs is None:
        return iss
    keys = list(keys)
    spelled = F.col("constraint").rlike("/(format|pattern)$") & (F.col("path") != "") & ~F.col("path").endswith("[]")
    from pactline.functions.json_types import json_text
    from pactline.session import broadcast_checked

    asked = iss.where(spelled).select(*keys, "path").distinct()
    strings = obs.where("type = 'string'").join(broadcast_checked(asked), [*keys, "path"], "left_semi")
    shapes = common_pattern(strings.withColumn("_text", json_text(F.col("value_json"))), [*keys, "path"], "_text")
    shaped = F.struct(
        F.lit("constrainPattern").alias("kind"), F.lit(None).cast("array<string>").alias("types"),
        F.lit(None).cast("array<string>").alias("values"), F.col("pattern").alias("pattern"),
    ).cast(FIX_TYPE)
    return (
        iss.join(shapes, [*keys, "path"], "left")
        .withColumn("fix", F.when(spelled & F.col("pattern").isNotNull(), shaped).otherwise(F.col("fix")))
        .drop("pattern")
    )


def unregistered(keys: DataFrame, matches: DataFrame) -> DataFrame:
    """Event types no contract claims, as issue rows. `keys` has the volume per type."""
    left = keys.join(matches.select("source", "event_type").distinct(), ["source", "event_type"], "left_anti")
    return left.select(
        event_key(F.col("source"), F.col("event_type")).alias("name"),
        F.lit("unregistered").alias("kind"),
        F.lit("unregistered").alias("key"),
        F.lit("").alias("path"),
        F.lit("warning").alias("severity"),
        F.lit(False).alias("rejects"),
        F.col("observed").alias("affected"),
        F.col("observed").alias("sampled"),
        F.concat(F.lit("no contract for "), "event_type", F.lit(" of "), "source").alias("summary"),
        F.lit("nothing").alias("declared"),
        F.concat(
            F.col("observed").cast("string"), F.when(F.col("observed") == 1, " event on the bus").otherwise(" events on the bus")
        ).alias("observed"),
    )


def with_example(events: DataFrame, types: DataFrame) -> DataFrame:
    """Newest payload per event type, for the types in `types`."""
    wanted = events.join(types.select("source", "event_type"), ["source", "event_type"], "left_semi")
    newest = top_n_per_group(
        wanted.select("source", "event_type", "ts", "event_id", "detail"), ["source", "event_type"],
        [F.desc("ts"), F.asc("event_id")], 1, spread="event_id",
    )
    return types.join(newest.select("source", "event_type", F.to_json("detail").alias("example")), ["source", "event_type"], "left")


def concerns_to_issues(df: DataFrame) -> DataFrame:
    """Concerns raised by a person, in the shape of an issue."""
    zero = F.lit(0).cast("bigint")
    return df.select(
        "name",
        F.lit("concern").alias("kind"),
        F.concat(F.lit("concern:"), F.when(F.col("path") == "", "event").otherwise(F.col("path"))).alias("key"),
        "path",
        F.lit("warning").alias("severity"),
        F.lit(False).alias("rejects"),
        zero.alias("affected"),
        zero.alias("sampled"),
        "summary",
        F.col("detail").alias("action"),
    )


def outstanding(iss: DataFrame, resolutions: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Issues nobody has dealt with."""
    return iss.join(resolutions.select(*keys, "key").distinct(), [*keys, "key"], "left_anti")


def outstanding_counts(iss: DataFrame, resolutions: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Per key: open issues, those above a note, and resolved ones split by how."""
    keys = list(keys)
    left = outstanding(iss, resolutions, tuple(keys)).groupBy(*keys).agg(
        F.count("*").alias("open"), F.count_if(F.col("severity") != "info").alias("drifting")
    )
    done = resolutions.groupBy(*keys).agg(
        F.count_if(F.col("how") == "fixed").alias("fixed"), F.count_if(F.col("how") != "fixed").alias("filed")
    )
    return left.join(done, keys, "full_outer").fillna(0, ["open", "drifting", "fixed", "filed"])


def group_siblings(iss: DataFrame, keys: tuple[str, ...] = ("name",), listed: int = LISTED_SIBLINGS) -> DataFrame:
    """Undeclared fields of one parent as one row; everything else stays alone.

    `fields` counts all of them; `paths` has the first `listed`, so an object with a field per id stays one small row.
    """
    has_parent = (F.col("kind") == "undeclared") & F.col("path").contains(".")
    parent = F.when(has_parent, F.regexp_replace("path", r"\.[^.]*$", ""))
    part = [*keys, "kind", "parent", "_alone"]
    rows = iss.withColumns({"parent": parent, "_alone": F.when(~has_parent, F.col("key")), "_sev": severity_rank()})
    shown = top_n_per_group(rows.select(*part, "path"), part, [F.asc("path")], listed, spread="path").select(*part, "path", F.lit(True).alias("_shown"))
    counted = rows.groupBy(*part).agg(F.count("*").alias("fields"), F.min("_sev").alias("_sev"))
    both = counted.unionByName(shown, allowMissingColumns=True)
    return (
        both.groupBy(*part)
        .agg(
            F.max("fields").alias("fields"), F.array_sort(F.collect_list(F.when(F.col("_shown"), F.col("path")))).alias("paths"),
            F.min("_sev").alias("_sev"),
        )
        .withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("_sev") + 1))
        .drop("_sev", "_alone")
    )


def issue_examples(iss: DataFrame, values: DataFrame, keys: tuple[str, ...] = ("name",), n: int = MAX_EXAMPLES) -> DataFrame:
    """At most `n` values seen at an issue's path, values outside the enum first.

    `values` has `path, value_json, priority, pos`; null values are no evidence.
    """
    shown = values.where("value_json IS NOT NULL AND value_json <> 'null'").join(
        iss.select(*keys, "key", "path"), [*keys, "path"]
    )
    order = [F.asc("priority"), F.asc("pos"), F.asc("value_json")]
    cut = top_n_per_group(shown, [*keys, "key"], order, n, spread="value_json")
    rank = F.row_number().over(W.partitionBy(*keys, "key").orderBy(*order))
    return cut.select(*keys, "key", rank.alias("pos"), "value_json")
