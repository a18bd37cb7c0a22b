"""Contracts drafted from traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions.json_types import JSON_TYPES, json_text
from pactline.functions.names import is_id_like
from pactline.session import cut

# What an inferred format looks like, in the order they are tried.
FORMAT_PATTERNS = (
    ("date-time", r"(?s)^[0-9]{4}-.{2}-.{2}[T ].{2}:.{6,}$"),
    ("uuid", r"^(?=.{36}$)[0-9a-fA-F-]{8}-[0-9a-fA-F-]{4}-[0-9a-fA-F-]{4}-[0-9a-fA-F-]{4}-[0-9a-fA-F-]{12}$"),
    ("email", r"(?s)^(?=.{6,}$)(?=[^ ]*$)(?=.*@)(?=.*[.]).*$"),
)


def detect_format(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Format per path, claimed only when every string there matches."""
    text = json_text(F.col("value_json"))
    strings = obs.where("type = 'string'").groupBy(*keys, "path").agg(
        *[F.bool_and(text.rlike(p)).alias(f"_f{i}") for i, (_, p) in enumerate(FORMAT_PATTERNS)]
    )
    return strings.select(*keys, "path", _format_case().alias("format")).where("format IS NOT NULL")


def _format_case() -> Column:
    out = None
    for i, (name, _) in enumerate(FORMAT_PATTERNS):
        out = F.when(F.col(f"_f{i}"), name) if out is None else out.when(F.col(f"_f{i}"), name)
    return out


def infer_contract(obs: DataFrame, keys: tuple[str, ...] = ("source", "event_type")) -> DataFrame:
    """One inferred field row per path.

    Occurrences are counted, not events: `required` asks whether an ID-like name was in every object
    occurrence. One non-null type wins, integer among numbers is number, anything else stays
    untyped and hides what lies below it. `obs` needs `include_root=True`.
    """
    keys = list(keys)
    text = json_text(F.col("value_json"))
    is_string = F.col("type") == "string"
    counts = obs.groupBy(*keys, "path", "parent_path").agg(
        F.count("*").alias("occurrences"),
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in JSON_TYPES],
        *[
            F.bool_and(F.when(is_string, text.rlike(p))).alias(f"_f{i}")
            for i, (_, p) in enumerate(FORMAT_PATTERNS)
        ],
    )
    seen = F.filter(
        F.array(*[F.when(F.col(f"n_{t}") > 0, F.lit(t)) for t in JSON_TYPES if t != "null"]),
        lambda t: t.isNotNull(),
    )
    numeric = F.array(F.lit("integer"), F.lit("number"))
    typed = (
        F.when(F.size(seen) == 1, F.get(seen, 0)).when(seen == numeric, F.lit("number"))
    )
    leaf = F.regexp_extract("path", r"([^.]*)$", 1)
    # Contract-sized and read four times below.
    nodes = cut(counts.select(
        *keys, "path", "parent_path", "occurrences", typed.alias("type"),
        (typed.isNotNull() & (F.col("n_null") > 0)).alias("nullable"),
        F.col("n_object").alias("objects"),
        F.when(typed == "string", _format_case()).alias("format"),
        leaf.alias("leaf"),
    ))
    # A path survives only below objects and arrays: drop what hangs under an untyped node.
    untyped = nodes.where("type IS NULL AND path <> ''").select(*keys, F.col("path").alias("_cut"))
    ancestors = nodes.select(*keys, "path", F.explode(_ancestors(F.col("path"))).alias("_cut"))
    hidden = ancestors.join(untyped, [*keys, "_cut"]).select(*keys, "path").distinct()
    parents = nodes.select(*keys, F.col("path").alias("parent_path"), F.col("objects").alias("_parent_objects"))
    return (
        nodes.join(hidden, [*keys, "path"], "left_anti")
        .join(parents, [*keys, "parent_path"], "left")
        .where("path <> ''")
        .select(
            *keys,
            "path",
            "type",
            "nullable",
            (
                is_id_like(F.col("leaf")) & ~F.col("path").endswith("[]")
                & (F.col("occurrences") == F.col("_parent_objects"))
            ).alias("required"),
            "format",
            "occurrences",
        )
    )


def _ancestors(path: Column) -> Column:
    """Proper prefixes of a path at `.` and `[]` boundaries."""
    steps = F.split(F.regexp_replace(path, r"\[\]", ".[]"), r"\.")
    prefix = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))),
        lambda i: F.replace(F.array_join(F.slice(steps, F.lit(1), i), "."), F.lit(".[]"), F.lit("[]")),
    )
    return F.when(F.size(steps) > 1, prefix).otherwise(F.array().cast("array<string>"))


def propose_fields(undeclared: DataFrame, top_level_only: bool = False) -> DataFrame:
    """Each undeclared field as a declaration: typed when one type was seen, open when an object."""
    rows = undeclared
    if top_level_only:
        rows = rows.where(~F.col("path").contains(".") & ~F.col("path").contains("[]"))
    named = F.array_remove("types", "null")
    single = F.when(F.size(named) == 1, F.get(named, 0))
    return rows.withColumns(
        {
            "type": single,
            "nullable": single.isNotNull() & F.array_contains("types", "null"),
            "open": F.coalesce(single == "object", F.lit(False)),
        }
    ).drop("types")
