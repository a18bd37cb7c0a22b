"""Contract versions: differences, the ledger of changes, reconciliation, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.operators.ranking import top_n_per_group

# Fixed value: versions a ledger looks back over.
HISTORY_VERSIONS = 25

# What a field declares, by its column in the field table, and what a reader calls it.
_COMPARED = {
    "above": "exclusive minimum", "any_of": "alternatives", "below": "exclusive maximum", "closed": "closed", "const_json": "constant",
    "enum_json": "values", "format": "format", "max_items": "most items", "max_len": "most characters", "max_props": "most members",
    "maximum": "maximum", "min_items": "least items", "min_len": "least characters", "min_props": "least members", "minimum": "minimum",
    "multiple_of": "divisor", "one_of": "exclusive alternatives", "pattern": "pattern", "ref_target": "reference", "required": "required",
    "types": "types", "ungradable": "ungraded keywords", "unique_items": "unique items",
}
_LISTS = ("any_of", "enum_json", "one_of", "types", "ungradable")


def _notes() -> Column:
    """One line a column that differs, in the order of the columns; `a` is the older side."""

    def shown(side: str, name: str) -> Column:
        col = F.col(f"{side}.{name}")
        return F.coalesce(F.array_join(col, ", ") if name in _LISTS else col.cast("string"), F.lit("not set"))

    return F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")),
                    F.concat(F.lit(f"{said} was "), shown("a", name), F.lit(", is "), shown("b", name)),
                )
                for name, said in _COMPARED.items()
            ]
        )
    )


def _diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    cols = [*keys, "path", *_COMPARED]
    a, b = old.select(cols).alias("a"), new.select(cols).alias("b")
    on = F.col("a.path") == F.col("b.path")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = a.join(b, on, "full_outer")
    change = (
        F.when(F.col("a.path").isNull(), "added")
        .when(F.col("b.path").isNull(), "removed")
        .when(F.size(_notes()) > 0, "changed")
    )
    detail = F.when(F.col("a.path").isNotNull() & F.col("b.path").isNotNull(), _notes()).otherwise(
        F.array().cast("array<string>")
    )
    picked = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in [*keys, "path"]]
    return joined.select(*picked, change.alias("change"), detail.alias("detail")).where("change IS NOT NULL")


def contract_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Added, removed and changed fields between two field tables, with words for each change."""
    return _diff(old.where("depth > 0"), new.where("depth > 0"), list(keys))


def diff_counts(diff: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """Fields added, removed and changed per key."""
    return diff.groupBy(*keys).agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")]
    )


def change_ledger(fields: DataFrame, versions: int | None = HISTORY_VERSIONS) -> DataFrame:
    """Changes of every field between consecutive versions, over the newest `versions` of a contract (None: all).

    Versions are paired by rank, so one join compares all pairs at once.
    """
    ranked = fields.select("name", "version").distinct().withColumn(
        "_rank", F.row_number().over(W.partitionBy("name").orderBy(F.desc("version")))
    )
    recent = ranked if versions is None else ranked.where(F.col("_rank") <= versions)
    rows = fields.where("depth > 0").join(recent, ["name", "version"])
    newer = recent.select("name", F.col("_rank"), "version")
    has_older = recent.select("name", (F.col("_rank") - 1).alias("_rank")).where("_rank > 0")
    newer = newer.join(has_older, ["name", "_rank"], "left_semi")
    older = rows.withColumn("_rank", F.col("_rank") - 1).where("_rank > 0")
    pairs = _diff(older, rows.join(has_older, ["name", "_rank"], "left_semi"), ["name", "_rank"])
    return pairs.join(newer, ["name", "_rank"]).select("name", "path", "version", "change", "detail")


def recurring_fields(ledger: DataFrame) -> DataFrame:
    """Fields changed in more than one version, worst first."""
    counts = ledger.groupBy("name", "path").agg(
        F.count("*").alias("changes"), F.max("version").alias("last_version")
    )
    return counts.where("changes > 1").orderBy(F.desc("changes"), "name", "path")


def reconcile(candidate: DataFrame, live: DataFrame) -> DataFrame:
    """Import plan: `create`, `update`, `unchanged` or `error` per candidate.

    Documents are compared as canonical JSON, so member order and spacing are no change. Both sides
    have `name, doc`; an unreadable candidate has a NULL `doc`.
    """
    # What is shuffled is a digest of either text, not the documents.
    digest = F.sha2(F.to_json("doc"), 256)
    held = live.select("name", digest.alias("_live"))
    return candidate.select("name", digest.alias("_text")).join(held, "name", "left").select(
        "name",
        F.when(F.col("_text").isNull(), "error")
        .when(F.col("_live").isNull(), "create")
        .when(F.col("_live") == F.col("_text"), "unchanged")
        .otherwise("update")
        .alias("action"),
    )


def search_contracts(df: DataFrame, query: str) -> DataFrame:
    """Contracts in which every term appears, with a rank (0 best) and the A-Z bucket."""
    terms = query.strip().lower().split()
    q = query.strip().lower()
    source, event_type = F.lower(F.coalesce("source", F.lit(""))), F.lower(F.coalesce("event_type", F.lit("")))
    hay = F.concat_ws(" ", source, event_type, F.lower("name"))
    cond = F.lit(True)
    for term in terms:
        cond = cond & hay.contains(term)
    rank = (
        F.when(source.startswith(q), 0)
        .when(event_type.startswith(q), 1)
        .when(source.contains(q), 2)
        .when(event_type.contains(q), 3)
        .otherwise(4)
    )
    first = F.upper(F.left(F.trim(F.coalesce("source", F.lit(""))), F.lit(1)))
    return df.where(cond).withColumns(
        {"rank": rank if q else F.lit(0), "bucket": F.when(first.rlike("^[A-Z]$"), first).otherwise("#")}
    )


def search_groups(df: DataFrame, query: str, pinned: tuple[str, ...] = ()) -> DataFrame:
    """Matches grouped by source: pinned first, then the best rank any of them reached, then by name."""
    source = F.coalesce("source", F.lit("(ungrouped)"))
    groups = search_contracts(df, query).groupBy(source.alias("source")).agg(
        F.min("rank").alias("rank"), F.count("*").alias("contracts")
    )
    is_pinned = F.col("source").isin(*pinned) if pinned else F.lit(False)
    return groups.withColumn("pinned", is_pinned).orderBy(F.desc("pinned"), "rank", "source")


def newest_versions(df: DataFrame, n: int) -> DataFrame:
    """Newest `n` versions of every contract, in numeric order."""
    return top_n_per_group(df, ["name"], [F.desc("version")], n)
