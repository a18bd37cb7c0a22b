"""Grading events against contracts: the plan behind reports, single checks and per-event checks."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.functions.names import path_step, repeats
from pactline.operators import drift as d
from pactline.operators import issues as i
from pactline.operators import violations as v
from pactline.operators.clauses import (
    Clauses, answered, composed_violations, contract_clauses, declared_beyond, one_a_path, with_wildcards,
)
from pactline.operators.contracts import contract_fields, match_contracts, payload_type
from pactline.operators.observe import event_paths, observe, profile_from_counts, type_set_counts
from pactline.session import broadcast_checked, cut
from pactline.sources.events import newest_first, traffic_keys

KEYS = ("name",)


class Check:
    """Lazy tables of one grading run.

    `events` has `event_id, ts, source, event_type, detail`; `contracts` has `name, version, doc`,
    one version per name. Everything is graded, with no sample. The payloads are walked twice: once
    reduced to (event, path) for the profile, once per occurrence for the constraints. What is
    shuffled is the profile's partial counts and the rows that break a constraint. Both results are
    contract-sized and written once; all tables below are derived from them.
    """

    def __init__(
        self, events: DataFrame, contracts: DataFrame, names: list[str] | None = None, keys: DataFrame | None = None
    ):
        if names is not None:
            contracts = contracts.where(F.col("name").isin(*names))
        self.events = events
        self.contracts = contracts
        self._keys = keys

    @cached_property
    def keys(self) -> DataFrame:
        """Event types on the bus with their volume."""
        return cut(traffic_keys(self.events)) if self._keys is None else self._keys

    @cached_property
    def matches(self) -> DataFrame:
        """Contract to event key."""
        return cut(match_contracts(self.contracts, self.keys))

    @cached_property
    def readable(self) -> DataFrame:
        """Contracts whose payload type can be found."""
        return self.contracts.where(payload_type().isNotNull())

    @cached_property
    def clauses(self) -> Clauses | None:
        """Composition, wildcards and nested arrays of the contracts; None if they hold nothing of it."""
        return contract_clauses(self.readable)

    @cached_property
    def fields(self) -> DataFrame:
        """The field table; marks of what the clauses grade are taken off."""
        fields = contract_fields(self.readable, ("name",))
        return fields if self.clauses is None else answered(fields, self.clauses)

    @cached_property
    def rules(self) -> DataFrame:
        """Everything that holds always: the field table, and what the clauses declare beyond it."""
        if self.clauses is None:
            return self.fields
        return cut(self.fields.unionByName(declared_beyond(self.clauses), allowMissingColumns=True))

    @cached_property
    def declared(self) -> DataFrame:
        """The rules, one row a path, as drift compares them with the profile."""
        return self.fields if self.clauses is None else cut(one_a_path(self.rules))

    @cached_property
    def graded(self) -> DataFrame:
        """Events with the contract they are graded against; the rest is not carried further."""
        able = self.matches.join(self.readable.select("name"), "name", "left_semi")
        chosen = broadcast_checked(able.select("name", "source", "event_type"))
        rows = self.events.join(chosen, ["source", "event_type"]).select("name", "event_id", "ts", "detail")
        return rows if self.clauses is None else with_wildcards(rows, self.clauses)

    @cached_property
    def _wild(self) -> str | None:
        return "wild" if "wild" in self.graded.columns else None

    @cached_property
    def profile(self) -> DataFrame:
        counts = cut(type_set_counts(event_paths(self.graded, KEYS, wild=self._wild), list(KEYS)))
        return profile_from_counts(counts, list(KEYS))

    @cached_property
    def sampled(self) -> DataFrame:
        """Events per contract: the count of the payload itself."""
        return self.profile.where("path = ''").select("name", F.col("seen_in").alias("sampled"))

    @cached_property
    def occurrences(self) -> DataFrame:
        return observe(self.graded, ("name", "event_id", "ts"), container_json=True, include_root=True, wild=self._wild)

    def _violations(self, mark_ungraded: bool = False) -> DataFrame:
        found = v.violations(self.occurrences, self.rules, mark_ungraded=mark_ungraded)
        return found if self.clauses is None else found.unionByName(composed_violations(self.occurrences, self.clauses))

    @cached_property
    def violations(self) -> DataFrame:
        return self._violations()

    @cached_property
    def causes(self) -> DataFrame:
        return cut(v.causes(self._violations(mark_ungraded=True)))

    @cached_property
    def enum_values(self) -> DataFrame:
        """Every value outside its enum, one row each: what `apply_repairs` adds to the enum."""
        return self.causes.where("value IS NOT NULL").select("name", "path", F.col("value").alias("value_json")).distinct()

    @cached_property
    def failures(self) -> DataFrame:
        return v.group_failures(self.causes)

    @cached_property
    def verdicts(self) -> DataFrame:
        return v.verdicts(self.sampled, self.causes)

    @cached_property
    def drift(self) -> dict[str, DataFrame]:
        fields, prof = self.declared, self.profile
        return {
            "undeclared": d.drift_undeclared(prof, fields),
            "unused": d.drift_unused(prof, fields),
            "types": d.drift_types(prof, fields),
            "enum": d.enum_from_causes(self.causes),
            "missing": d.drift_missing(prof, fields),
            "blank": d.drift_blank(prof, fields),
        }

    @cached_property
    def issues(self) -> DataFrame:
        return cut(i.issues(self.drift_rows, self.failures, self.sampled))

    @cached_property
    def drift_rows(self) -> DataFrame:
        """The six kinds in one table."""
        return cut(i.drift_rows_from(d.drift_all(self.profile, self.declared), d.enum_from_causes(self.causes)))

    @cached_property
    def ranked(self) -> DataFrame:
        return i.rank_issues(self.issues)

    @cached_property
    def unregistered(self) -> DataFrame:
        return i.unregistered(self.keys, self.matches)

    @cached_property
    def ungradable(self) -> DataFrame:
        """Constraints that were not graded, per contract."""
        marks = self.rules.where("size(ungradable) > 0 OR cyclic")
        return marks.groupBy("name").agg(
            F.sum(F.size("ungradable") + F.col("cyclic").cast("int")).cast("bigint").alias("ungraded")
        )


def check_contract(events: DataFrame, name: str, document: str, start=None, end=None) -> Check:
    """Check one document, a draft included, over a window of events."""
    from pactline.sources.contracts_io import parse_contracts
    from pactline.sources.events import scan_events

    rows = events.sparkSession.createDataFrame([(name, 1, document)], "name string, version int, content string")
    contracts, _ = parse_contracts(rows)
    return Check(scan_events(events, start, end), contracts)


def event_issues(graded: DataFrame, fields: DataFrame, clauses: Clauses | None = None) -> DataFrame:
    """Issues of every event graded on its own: `name, event_id, ts, kind, path, key, rejects`.

    One walk, one join to the broadcast field table, one fold of the findings by event. A key found
    on a set of events is found again on the single events behind it. Notes about fields never seen
    are left out. `rejects` says whether a constraint broke. `fields` and `clauses` are the rules and clauses of a `Check`.
    """
    rules = broadcast_checked(
        fields.select("name", "path", "required", F.lit(True).alias("_declared"), v.pointer_of(fields), *v.CONSTRAINED)
    )
    wild = "wild" if "wild" in graded.columns else None
    occ = observe(graded, ("name", "event_id", "ts"), container_json=True, include_root=True, wild=wild)
    j = v.with_facts(occ.join(rules, ["name", "path"], "left"))
    inside = F.col("path") != ""
    wrong = (F.size("types") > 0) & (F.size(d.unexpected_types(F.array("type"), F.col("types"))) > 0)
    outside = (
        F.col("enum_json").isNotNull() & ~F.array_contains("enum_json", F.col("value_json"))
        & ~F.col("type").isin("object", "array", "null")
    )
    members = F.col("_members")  # set where the rule requires any
    child = F.when(inside, F.concat("path", F.lit("."))).otherwise("")
    shape = "array<struct<class:string,path:string,constraint:string,drift:boolean,rejects:boolean>>"
    nothing = F.array().cast(shape)

    def row(cls: str, path, drift, rejects):
        return F.struct(
            F.lit(cls).alias("class"), path.alias("path"), F.lit(cls).alias("constraint"),
            drift.alias("drift"), rejects.alias("rejects"),
        )

    def found(kind: str, cond):
        hit = F.array(row(kind, F.col("path"), F.lit(True), F.lit(False))).cast(shape)
        return F.when(F.coalesce(cond, F.lit(False)), hit).otherwise(nothing)

    # Below an array a member is missing from the event only when no occurrence has it, so there the
    # occurrences that do are reported too.
    absent = F.filter(
        F.transform(
            F.when(members.isNotNull(), F.col("required_names")),
            lambda n: row(
                "missingRequired", F.concat(child, path_step(n)),
                # A name required but not declared is a broken constraint, no drift of a field.
                ~F.array_contains(members, n) & F.array_contains("declared_names", n), ~F.array_contains(members, n),
            ),
        ),
        lambda r: r["drift"] | r["rejects"] | repeats(r["path"]),
    )
    broken = F.transform(
        v.in_one(*v.value_checks(members_too=False)),
        lambda b: F.struct(
            b["class"].alias("class"), b["path"].alias("path"), b["constraint"].alias("constraint"),
            F.lit(False).alias("drift"), F.lit(True).alias("rejects"),
        ),
    )
    rows = j.select(
        "name", "event_id", "ts",
        F.inline(
            v.in_one(
                found("undeclared", F.col("_declared").isNull() & inside),
                found("wrongType", wrong & inside),
                found("outsideEnum", outside),
                found("emptyRequired", F.col("required") & F.col("is_blank")),
                F.coalesce(absent.cast(shape), nothing),
                broken.cast(shape),
            )
        ),
    )
    if clauses is not None:
        composed = composed_violations(occ, clauses).select(
            "name", "event_id", "ts", "class", "path", "constraint", F.lit(False).alias("drift"), F.lit(True).alias("rejects")
        )
        rows = rows.unionByName(composed)
    drift = F.when(F.col("class") == "missingRequired", F.bool_and("drift")).otherwise(F.bool_or("drift"))
    folded = rows.groupBy("name", "event_id", "ts", "class", "path", "constraint").agg(
        drift.alias("drift"), F.bool_or("rejects").alias("rejects")
    )
    kind = F.when(F.col("drift"), F.col("class")).otherwise("rejected")
    return folded.where("drift OR rejects").select(
        "name", "event_id", "ts", kind.alias("kind"), "path",
        F.when(F.col("drift"), F.concat_ws(":", "class", "path"))
        .otherwise(F.concat_ws(":", F.lit("rejected"), "path", "constraint"))
        .alias("key"),
        "rejects",
    )


def check_each(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """Issue keys of each event on its own; an event type without a contract is its single finding."""
    c = Check(events, contracts)
    found = event_issues(c.graded, c.rules, c.clauses).drop("rejects")
    claimed = broadcast_checked(c.matches.select("source", "event_type").distinct())
    loose = events.join(claimed, ["source", "event_type"], "left_anti").select(
        F.concat("source", F.lit("@"), "event_type").alias("name"), "event_id", "ts",
        F.lit("unregistered").alias("kind"), F.lit("").alias("path"), F.lit("unregistered").alias("key"),
    )
    return found.unionByName(loose)


def events_for_issue(
    events: DataFrame, contracts: DataFrame, name: str, key: str, n: int = i.EVENTS_PER_ISSUE,
    start: dt.datetime | None = None, end: dt.datetime | None = None,
) -> DataFrame:
    """Newest `n` events that show one issue.

    With a window `[start, end)` the payloads are graded newest first, slice by slice, until `n` are found. What decides
    which event type the contract is graded against is counted over all events, from two columns, in either form.
    """
    whole = Check(events, contracts, [name])
    columns = ["name", "event_id", "ts", "detail"]

    def shown(rows: DataFrame) -> DataFrame:
        c = Check(rows, contracts, [name], keys=whole.keys)
        c.matches, c.clauses, c.rules = whole.matches, whole.clauses, whole.rules
        found = event_issues(c.graded, c.rules, c.clauses)
        ids = found.where(F.col("key") == key).select("event_id").distinct()
        return c.graded.join(ids, "event_id", "left_semi").select(*columns)

    if start is None or end is None:
        return shown(events).orderBy(F.desc("ts"), "event_id").limit(n)
    return newest_first(events, shown, n, start, end, columns=columns).select(*columns)
