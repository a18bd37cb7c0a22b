"""Where a finding goes, and whether it is already filed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions.globs import specificity
from pactline.functions.names import label, split_identity
from pactline.functions.text import plain
from pactline.operators.containment import contained_in
from pactline.operators.glob_join import join_globs
from pactline.operators.ranking import top_n_per_group

# The label every ticket of ours carries, and the key all roll-ups share.
TICKET_LABEL = "contract-drift"
ROLLUP_KEY = "rollup"


def route(
    findings: DataFrame, routes: DataFrame, owner_routes: DataFrame, default_project: str | None = None, default_type: str = "Bug"
) -> DataFrame:
    """Add `project, issue_type, rule, reason`: best source rule, else owner rule, else the default.

    Rules have `pos, pattern, project, issue_type`. Only distinct sources and owners meet the rules;
    findings then join the decisions on equal keys. A finding may list `owners`, and name its `repo`, which an owner
    rule can match too, after them.
    """
    columns = findings.columns
    repo = F.when(F.col("repo").isNotNull(), F.array("repo")) if "repo" in columns else F.lit(None)
    none = F.array().cast("array<string>")
    findings = findings.withColumn("_who", F.concat(F.coalesce("owners", none), F.coalesce(repo.cast("array<string>"), none)))
    src = findings.select("source").distinct()

    def usable(rules: DataFrame) -> DataFrame:
        return rules.where("trim(project) <> '' AND trim(pattern) <> ''").select(
            "pos", F.trim("pattern").alias("_glob"), "pattern", F.trim("project").alias("project"), "issue_type"
        )

    by_source = top_n_per_group(
        join_globs(src, "source", usable(routes), "_glob", ignore_case=True),
        ["source"], [specificity(F.col("pattern")).desc(), F.desc("pos")], 1,
    ).select("source", F.struct("pattern", "project", "issue_type").alias("_s"))
    # Few names own much: each name meets the rules once.
    own = findings.select("_who").distinct().select("_who", F.posexplode("_who").alias("_i", "owner"))
    ruled = join_globs(own.select("owner").distinct(), "owner", usable(owner_routes), "_glob", ignore_case=True)
    ruled = top_n_per_group(ruled, ["owner"], [F.asc("pos")], 1)
    by_owner = top_n_per_group(own.join(ruled, "owner"), ["_who"], [F.asc("pos"), F.asc("_i")], 1).select(
        "_who", F.struct("owner", "pattern", "project", "issue_type").alias("_o")
    )
    s, o = F.col("_s"), F.col("_o")
    default = F.lit(default_project.strip() if default_project and default_project.strip() else None)
    reason = (
        F.when(s.isNotNull(), F.concat(F.lit("source rule "), s["pattern"]))
        .when(
            o.isNotNull(),
            F.concat(F.lit("owner rule "), o["pattern"], F.lit(", by "), o["owner"]),
        )
        .when(default.isNotNull(), F.lit("default project"))
    )
    named = F.coalesce(F.when(s.isNotNull(), s["issue_type"]), F.when(s.isNull(), o["issue_type"]))
    return (
        findings.join(by_source, "source", "left")
        .join(by_owner, "_who", "left")
        .select(
            *columns,
            F.coalesce(s["project"], o["project"], default).alias("project"),
            F.when(reason.isNotNull(), F.coalesce(F.when(F.trim(named) != "", named), F.lit(default_type))).alias("issue_type"),
            F.coalesce(s["pattern"], o["pattern"]).alias("rule"),
            reason.alias("reason"),
        )
    )


def suggest_patterns(sources: DataFrame) -> DataFrame:
    """`family-*` for every prefix more than one source shares, then every source, in that order."""
    one = sources.select("source").distinct()
    head = F.get(F.split("source", "[-. ]"), 0)
    families = (
        one.withColumn("_head", head)
        .where((F.col("_head") != "") & (F.col("_head") != F.col("source")))
        .groupBy("_head")
        .agg(F.count("*").alias("_n"))
        .where("_n > 1")
        .select(F.lit(0).alias("band"), F.concat("_head", F.lit("-*")).alias("pattern"))
    )
    return families.unionByName(one.select(F.lit(1).alias("band"), F.col("source").alias("pattern"))).orderBy("band", "pattern")


def fingerprint(env: Column, name: Column, key: Column) -> Column:
    """Identity of a problem across samples."""
    return F.concat(F.lit(TICKET_LABEL + "-"), F.left(F.sha1(F.concat_ws("|", env, name, key).cast("binary")), F.lit(12)))


def identify(findings: DataFrame, env: str) -> DataFrame:
    """Add `fingerprint` and `identity`, the labels an open ticket must carry to be the same problem.

    Findings have `name, source, event_type, key, path`.
    """
    field = F.when(F.col("path") != "", label(F.col("path")))
    labels = F.array(
        F.lit(TICKET_LABEL), label(F.lit(f"{env}-global-bus")), label(F.col("source")),
        F.when(F.col("event_type") != "", label(F.col("event_type"))), field,
    )
    return findings.withColumns(
        {
            "fingerprint": fingerprint(F.lit(env), F.col("name"), F.col("key")),
            "identity": F.array_distinct(F.filter(labels, lambda x: x.isNotNull())),
        }
    )


def match_tickets(findings: DataFrame, tickets: DataFrame) -> DataFrame:
    """Newest open ticket per finding: it carries all identity labels, or the fingerprint.

    Identities meet the tickets by containment. Of the tickets of an identity, or of a fingerprint, only the newest goes on,
    folded with map-side partials, so a finding meets one row of each.
    """
    open_ = tickets.where(~F.col("done")).select("ticket", "created", F.array_distinct("labels").alias("labels"))
    newest = F.min(F.struct((-F.col("created")).alias("age"), "ticket"))
    sets = findings.select(F.col("identity").alias("_identity")).distinct()
    by_labels = contained_in(sets, "_identity", open_, "labels").groupBy("_identity").agg(newest.alias("_full"))
    listed = open_.select("ticket", "created", F.explode("labels").alias("_print"))
    prints = findings.select(F.col("fingerprint").alias("_print")).distinct()
    by_print = listed.join(prints, "_print").groupBy("_print").agg(newest.alias("_named"))
    rows = findings.join(by_labels, F.col("identity") == F.col("_identity"), "left").join(by_print, F.col("fingerprint") == F.col("_print"), "left")
    return rows.select(*findings.columns, F.least("_full", "_named")["ticket"].alias("ticket"))


def filing_plan(routed: DataFrame, comment_on: DataFrame | None = None) -> DataFrame:
    """Add `outcome` per finding: `commented`, `skipped` (open duplicate), `failed` (no route), `created`.

    `routed` comes from `route` and `match_tickets`; `comment_on` names fingerprints whose open
    ticket should get a comment instead. The table is the output; nothing is sent.
    """
    rows = routed
    if comment_on is not None:
        chosen = comment_on.select("fingerprint", F.lit(True).alias("_comment")).distinct()
        rows = rows.join(chosen, "fingerprint", "left")
    else:
        rows = rows.withColumn("_comment", F.lit(None).cast("boolean"))
    outcome = (
        F.when(F.col("ticket").isNotNull() & ~F.coalesce("_comment", F.lit(False)), "skipped")
        .when(F.col("project").isNull(), "failed")
        .when(F.col("ticket").isNotNull(), "commented")
        .otherwise("created")
    )
    return rows.withColumn("outcome", outcome).drop("_comment")


def tickets_by_contract(tickets: DataFrame, contracts: DataFrame) -> DataFrame:
    """Tickets about each contract: labelled with its source and its event type."""
    source, event_type = split_identity(F.col("name"))
    wanted = contracts.select("name").distinct().select("name", F.array(label(source), label(event_type)).alias("_both"))
    wanted = wanted.where(F.forall("_both", lambda x: x.isNotNull()))
    rows = tickets.select("ticket", "created", "done", "labels")
    return contained_in(wanted, "_both", rows, "labels").select("name", "ticket", "created", "done", "labels")


def ticket_covers(tickets: DataFrame, paths: DataFrame) -> DataFrame:
    """`(name, path, ticket)` for the field paths whose label a contract's ticket carries."""
    marked = paths.select("name", "path", label(F.col("path")).alias("_label"))
    listed = tickets.select("name", "ticket", "created", "done", F.explode(F.array_distinct("labels")).alias("_label"))
    return marked.join(listed, ["name", "_label"]).select("name", "path", "ticket", "created", "done")


def ticket_by_path(covers: DataFrame) -> DataFrame:
    """The ticket to show for a field: an open one before a closed one, the newest of those."""
    order = [F.asc("done"), F.desc("created"), F.asc("ticket")]
    return top_n_per_group(covers, ["name", "path"], order, 1, spread="ticket")


def rollup(findings: DataFrame, window: str = "the window") -> DataFrame:
    """One ticket title and one recurrence text per event type.

    Findings have `name, source, event_type, summary, affected, sampled, rejects`.
    """
    keys = ["name", "source", "event_type"]
    worst = top_n_per_group(findings, keys, [F.desc("affected"), F.asc("summary")], 1).select(
        *keys, F.col("summary").alias("_summary"), F.col("affected").alias("_affected"), F.col("sampled").alias("_sampled")
    )
    rows = findings.groupBy(*keys).agg(
        F.count("*").alias("findings"), F.count_if("rejects").alias("rejecting")
    ).join(worst, keys)
    n, r = F.col("findings"), F.col("rejecting")
    tail = F.when(r == 0, "").otherwise(F.concat(F.lit(", rejecting: "), r.cast("string")))
    about = F.when(F.col("event_type") == "", F.col("name")).otherwise(F.col("event_type"))
    title = F.concat(
        F.lit("["), "source", F.lit("] "),
        F.when(n == 1, plain(F.col("_summary"))).otherwise(F.concat(about, F.lit(", contract findings: "), n.cast("string"), tail)),
    )
    numbers = F.concat(F.col("_affected").cast("string"), F.lit(" in "), F.col("_sampled").cast("string"), F.lit(" events"))
    again = F.concat(
        F.lit(f"Seen again in {window}: "), F.when(n == 1, numbers).otherwise(F.concat(n.cast("string"), F.lit(" findings, at most "), numbers))
    )
    return rows.select(*keys, "findings", "rejecting", title.alias("title"), again.alias("recurrence"))
