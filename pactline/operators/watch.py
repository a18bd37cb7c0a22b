"""Watches over event tables; every function that says so also runs on a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.functions.conditions import Watch, lookup, watch_expr
from pactline.functions.names import event_key
from pactline.operators.clauses import Clauses, with_wildcards
from pactline.operators.glob_join import join_globs
from pactline.operators.intervals import DAY_MS, count_inside
from pactline.operators.ranking import top_n_per_group
from pactline.session import broadcast_checked, cut

# Re-read overlap, look-back on arming, catch-up limit, retention, digest size.
OVERLAP = "90 seconds"
LOOK_BACK = "1 hour"
CATCH_UP = "1 hour"
HITS_PER_ENV = 1000
MARKS_PER_ENV = 200
SINGLE_MESSAGES = 3
PROBLEM_GRADES = ("failing", "drifting", "missing")


def match_watches(events: DataFrame, watches: list[Watch]) -> DataFrame:
    """One row per (event, watch it meets), with `watch_id`. One read whatever the number of watches.

    The OR over all watches filters before rows are multiplied, and its plain column parts reach the
    scan. Works on streams.
    """
    live = [w for w in watches if w.enabled]
    if not live:
        return events.withColumn("watch_id", F.lit("")).where(F.lit(False))
    tests = [watch_expr(w) for w in live]
    met = F.array_compact(F.array(*[F.when(t, F.lit(w.id)) for w, t in zip(live, tests)]))
    return events.where(reduce(lambda a, b: a | b, tests)).withColumn("watch_id", F.explode(met))


def backfill(events: DataFrame, watches: list[Watch], started_at) -> DataFrame:
    """Hits of the hour before arming and since, the former flagged `backfill`: context, not news."""
    at = F.lit(started_at)
    window = events.where(F.col("ts") >= at - F.expr(f"INTERVAL {LOOK_BACK}"))
    return match_watches(window, watches).withColumn("backfill", F.col("ts") < at)


def resume_window(events: DataFrame, cursor, now, catch_up: str = CATCH_UP, overlap: str = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Events to read after a pause, and one row saying which span was skipped (NULL when none).

    From the cursor less the overlap, but never further back than `catch_up`.
    """
    floor = F.lit(now) - F.expr(f"INTERVAL {catch_up}")
    start = F.greatest(F.lit(cursor) - F.expr(f"INTERVAL {overlap}"), floor)
    lost = events.where((F.col("ts") >= F.lit(cursor)) & (F.col("ts") < floor)).agg(
        F.count("*").alias("skipped_events"), F.min("ts").alias("skipped_from"), F.max("ts").alias("skipped_to")
    )
    return events.where((F.col("ts") >= start) & (F.col("ts") <= F.lit(now))), lost


def probe(events: DataFrame, watch: Watch, now, hours: int = 24) -> DataFrame:
    """How often a watch would have fired per event type in the last hours, and when last."""
    since = F.lit(now) - F.make_interval(hours=F.lit(hours))
    window = events.where((F.col("ts") >= since) & (F.col("ts") < F.lit(now)))
    hits = window.where(watch_expr(watch))
    return (
        hits.groupBy(event_key(F.col("source"), F.col("event_type")).alias("event_key"))
        .agg(F.count("*").alias("hits"), F.max("ts").alias("last_at"))
        .orderBy(F.desc("hits"), "event_key")
    )


def dedup_hits(hits: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Each (watch, event) once, and only those not stored yet.

    On a stream the first step keeps ids for the overlap and drops later ones, as the poller did;
    `stored` then belongs to the batch sink.
    """
    if hits.isStreaming:
        return hits.withWatermark("ts", OVERLAP).dropDuplicatesWithinWatermark(["watch_id", "event_id"])
    once = hits.dropDuplicates(["watch_id", "event_id"])
    if stored is None:
        return once
    return once.join(stored.select("watch_id", "event_id").distinct(), ["watch_id", "event_id"], "left_anti")


def rules_of(contracts: DataFrame) -> tuple[DataFrame, Clauses | None]:
    """What `grade_hits` grades by, for a caller that grades often against the same contracts."""
    from pactline.plans.check import Check

    check = Check(contracts.sparkSession.createDataFrame([], "event_id long"), contracts)
    return check.rules, check.clauses


def grade_hits(hits: DataFrame, contracts: DataFrame, rules: tuple[DataFrame, Clauses | None] | None = None) -> DataFrame:
    """Add `grade` (ok, failing, drifting, missing, unknown) and `headline_key` to every hit.

    `rules` are the `rules_of` the contracts, made here if not given. Each payload is graded alone: any violation fails it, any issue above a note makes it drift. The
    contract is looked up as exact, sanitised, then title name.
    """
    from pactline.functions.names import detail_title, sanitize_name
    from pactline.operators.contracts import payload_type
    from pactline.operators.issues import kind_rank
    from pactline.plans.check import event_issues

    exact = event_key(F.col("source"), F.col("event_type"))
    title = F.concat("source", F.lit("@"), detail_title(F.col("event_type")))
    kinds = hits.select("source", "event_type").distinct().select(
        "source", "event_type",
        F.posexplode(F.array(exact, sanitize_name(exact), title)).alias("rank", "name"),
    )
    able = contracts.withColumn("_able", payload_type().isNotNull()).select("name", "_able")
    held = top_n_per_group(kinds.join(able, "name"), ["source", "event_type"], [F.asc("rank")], 1).drop("rank")
    held = broadcast_checked(held)
    named = hits.join(held, ["source", "event_type"], "left")
    graded = named.where("_able").select("name", "event_id", "ts", "detail").dropDuplicates(["name", "event_id"])
    fields, clauses = rules or rules_of(contracts)
    found = event_issues(graded if clauses is None else with_wildcards(graded, clauses), fields, clauses)
    order = F.struct((~F.col("rejects")).alias("a"), F.col("path").alias("b"), kind_rank().alias("c"), F.col("key").alias("k"))
    verdict = found.groupBy("name", "event_id").agg(
        F.bool_or("rejects").alias("_failed"), F.min(order)["k"].alias("headline_key")
    )
    grade = (
        F.when(F.col("name").isNull(), "missing")
        .when(~F.col("_able"), "unknown")
        .when(F.col("_failed"), "failing")
        .when(F.col("headline_key").isNotNull(), "drifting")
        .otherwise("ok")
    )
    out = named.join(verdict, ["name", "event_id"], "left").withColumn("grade", grade)
    return out.select(*hits.columns, "grade", "headline_key")


def hit_digest(batch: DataFrame, watches: list[Watch]) -> DataFrame:
    """Messages of one batch: up to three single ones per watch, else one with the latest.

    `batch` has `watch_id, event_id, ts, source, event_type, envelope`; look-back hits are no news.
    """
    news = batch.where(~F.col("backfill")) if "backfill" in batch.columns else batch
    text = F.concat_ws(" · ", "source", "event_type")
    text = F.when(text != "", text).otherwise(F.col("event_id").cast("string"))
    notified = [w for w in watches if w.notify]
    extra, label = F.lit(""), F.lit(None).cast("string")
    for w in notified:
        shown = F.lit("")
        for c in w.conditions:
            if c.path.strip():
                v = lookup(F.col("envelope"), c.path)
                name = c.path.strip().rsplit(".", 1)[-1]
                value = F.try_variant_get(v, "$", "string")
                shown = F.concat(shown, F.when(v.isNotNull(), F.concat(F.lit(f" · {name}="), F.coalesce(value, F.lit("null")))).otherwise(""))
        extra = F.when(F.col("watch_id") == w.id, shown).otherwise(extra)
        label = F.when(F.col("watch_id") == w.id, w.label or w.id).otherwise(label)
    rows = news.where(F.col("watch_id").isin(*[w.id for w in notified])).select(
        "watch_id", label.alias("title"), "ts", "event_id", F.concat(text, extra).alias("body")
    )
    total = rows.groupBy("watch_id").agg(F.count("*").alias("hits"))
    newest = top_n_per_group(
        rows, ["watch_id"], [F.desc("ts"), F.asc("event_id")], SINGLE_MESSAGES, spread="event_id"
    ).withColumn("pos", F.row_number().over(W.partitionBy("watch_id").orderBy(F.desc("ts"), F.asc("event_id"))))
    many = F.col("hits") > SINGLE_MESSAGES
    body = F.when(many, F.concat(F.col("hits").cast("string"), F.lit(" events matched · latest: "), "body")).otherwise(F.col("body"))
    return newest.join(total, "watch_id").where(~many | (F.col("pos") == 1)).select(
        "watch_id", "title", "pos", body.alias("body"), "hits"
    )


def _spans(marks: DataFrame, end) -> DataFrame:
    """Starts with the next mark and the next stop, looked up day by day.

    Inside a day a window finds them; past its last mark the first ones of a later day do, so an
    environment of many marks is spread over its days.
    """
    day = F.floor(F.col("at") / DAY_MS)
    stop = F.when(F.col("kind") == "stop", F.col("at"))
    rows = marks.withColumn("_day", day)
    mark = F.struct("at", "mark_id", "kind")
    days = rows.groupBy("env", "_day").agg(F.min(mark).alias("_first"), F.min(stop).alias("_stop"))
    # What lies ahead is looked up from the end: a frame that ends at the last row is computed anew for every row.
    ahead = W.partitionBy("env").orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)
    days = days.select(
        "env", "_day", F.last("_first").over(ahead).alias("_later"), F.min("_stop").over(ahead).alias("_later_stop")
    )
    back = W.partitionBy("env", "_day").orderBy(F.desc("at"), F.desc("mark_id"))
    inside = rows.withColumns(
        {
            "_next": F.lag(mark).over(back),
            "_next_stop": F.min(stop).over(back.rowsBetween(W.unboundedPreceding, -1)),
        }
    ).where("kind = 'start'")
    nxt = F.coalesce("_next", "_later")
    return (
        inside.join(days, ["env", "_day"])
        .withColumns(
            {
                "next_at": nxt["at"], "next_kind": nxt["kind"], "stop_at": F.coalesce("_next_stop", "_later_stop"),
                "start_ms": F.col("at"),
            }
        )
        .withColumn("end_ms", end)
        .drop("_day", "_next", "_later", "_next_stop", "_later_stop")
    )


def _hits_in(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """`env, mark_id, hits` of the spans; an open end runs to the last hit there is."""
    # Hits are often the outcome of a search over the bus: what is counted is found once.
    at = cut(hits.groupBy("env", "at").agg(F.count("*").alias("n")))
    return count_inside(spans, at, ["env"], ["mark_id"], "at").withColumnRenamed("n", "hits")


def watch_sessions(hits: DataFrame, marks: DataFrame, live_since: int | None = None) -> DataFrame:
    """Sessions with their hits: from a start to the next mark of any kind, `watched_ms` if it was a stop.

    Hits and marks have `env, at` (epoch ms). Sessions without hits are dropped unless live.
    """
    spans = _spans(marks, F.col("next_at"))
    counts = _hits_in(spans, hits)
    live = F.coalesce(F.col("at") == F.lit(live_since), F.lit(False)) if live_since is not None else F.lit(False)
    return (
        spans.join(counts, ["env", "mark_id"], "left")
        .fillna(0, ["hits"])
        .withColumn("live", live)
        .where("hits > 0 OR live")
        .select(
            "env", "mark_id", F.col("at").alias("started_at"),
            F.when(F.col("next_kind") == "stop", F.col("next_at") - F.col("at")).alias("watched_ms"), "hits", "live",
        )
    )


def surviving_marks(marks: DataFrame, hits: DataFrame, live_since: int | None = None) -> DataFrame:
    """Marks worth keeping after hits were cleared: a start with a hit up to its next stop, and that stop."""
    spans = _spans(marks, F.col("stop_at"))
    used = _hits_in(spans, hits).where("hits > 0").select("env", "mark_id")
    live = F.col("at") == F.lit(live_since) if live_since is not None else F.lit(False)
    kept = spans.join(used.withColumn("_hit", F.lit(True)), ["env", "mark_id"], "left").where(F.col("_hit") | live)
    starts = kept.select("env", "mark_id")
    stops = marks.where("kind = 'stop'").join(
        kept.where("stop_at IS NOT NULL").select("env", F.col("stop_at").alias("at")).distinct(), ["env", "at"], "left_semi"
    )
    return starts.unionByName(stops.select("env", "mark_id"))


def watch_activity(hits: DataFrame, seen: DataFrame) -> DataFrame:
    """Hits, newest hit, unread and problem hits per watch.

    Unread: not look-back, and received after the environment was last looked at (`seen`: env, seen_at).
    """
    rows = hits.join(broadcast_checked(seen), "env", "left")
    unread = ~F.col("backfill") & (F.col("received_at") > F.coalesce("seen_at", F.lit(0)))
    return rows.groupBy("env", "watch_id").agg(
        F.count("*").alias("hits"),
        F.max("at").alias("latest"),
        F.count_if(unread).alias("unread"),
        F.count_if(F.col("grade").isin(*PROBLEM_GRADES)).alias("problems"),
    )


def retain_hits(hits: DataFrame, n: int = HITS_PER_ENV) -> DataFrame:
    """Newest `n` hits per environment."""
    return top_n_per_group(hits, ["env"], [F.desc("at"), F.asc("event_id"), F.asc("watch_id")], n, spread="event_id")


def retain_marks(marks: DataFrame, n: int = MARKS_PER_ENV) -> DataFrame:
    """Newest `n` marks per environment."""
    return top_n_per_group(marks, ["env"], [F.desc("at"), F.asc("mark_id")], n, spread="mark_id")


def watch_contracts(watches: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts a watch can reach by its globs; an empty glob reaches all.

    Source and type of a contract are one text, and the two patterns of a watch one rule over it.
    """

    def wanted(name: str):
        text = F.coalesce(F.trim(name), F.lit(""))
        return F.when(text == "", "*").otherwise(text)

    rules = watches.select("watch_id", F.concat(wanted("source"), F.lit("\u0001"), wanted("event_type")).alias("_pair"))
    names = contracts.select("name", "source", "event_type").distinct()
    names = names.select("name", F.concat("source", F.lit("\u0001"), "event_type").alias("_text"))
    return join_globs(names, "_text", rules, "_pair").select("watch_id", "name")
