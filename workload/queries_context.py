"""Registered queries over code files, routing, tickets, topology, logs and watches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactline.functions.conditions import Condition, Watch
from pactline.operators import readers, routing, topology
from pactline.operators import watch as wa
from pactline.operators.glob_join import join_globs
from pactline.sources import applog
from pactline.sources.events import scan_events
from workload import bus as w
from workload.oracle import sql
from workload.queries_core import DAY, START_MS, at, ms

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


# --- code files ---------------------------------------------------------------------------------

_C = """c AS (SELECT doc_id AS d, lang, 'repo-' || source AS repo, source AS src0,
  CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/test/' WHEN 2 THEN 'infra/' WHEN 3 THEN 'docs/' WHEN 4 THEN 'lib/api/' ELSE 'src/app/' END || lang || '/f' || doc_id
    || CASE doc_id % 5 WHEN 0 THEN '.yml' WHEN 1 THEN '.md' ELSE '.ts' END AS path,
  CASE WHEN doc_id % 4 = 3 THEN source || '-events' ELSE 'billing-ledger' END AS source, 'type-' || doc_id % 10 AS event_type, text FROM documents),
roles AS (SELECT *, contains(path, '/test') OR path LIKE '%.md' OR contains(path, '/docs/') AS incidental,
  CASE WHEN contains(path, '/test') OR path LIKE '%.md' OR contains(path, '/docs/') THEN 'mention' WHEN path LIKE '%.yml' THEN 'consumer'
    WHEN d % 7 = 0 THEN 'publisher' WHEN d % 11 = 0 THEN 'consumer'
    WHEN regexp_matches(lower(text), 'handler|subscri|targets|listener|consumer|rules:|rule\\(|onevent') THEN 'consumer'
    WHEN d % 4 = 3 AND length(src0) >= 4 THEN 'publisher' ELSE 'mention' END AS role FROM c)"""


def files(spark, sf):
    return readers.code_roles(w.code_files(spark, sf))


@query("code_roles", f"WITH {_C} SELECT d AS doc_id, role, incidental FROM roles")
def code_roles(spark, sf):
    return files(spark, sf).select("doc_id", "role", "incidental")


@query(
    "code_reads",
    f"""WITH {_C}, x AS (SELECT * FROM roles WHERE role <> 'publisher' AND NOT incidental) SELECT repo, path, read FROM (
    SELECT repo, path, 'shipperId' AS read FROM x WHERE d % 2 = 0 UNION ALL SELECT repo, path, 'cargo.manifestId' FROM x WHERE d % 3 = 0
    UNION ALL SELECT repo, path, 'amount' FROM x WHERE d % 5 = 0 UNION ALL SELECT repo, path, 'items[].sku' FROM x WHERE d % 5 = 0
    UNION ALL SELECT repo, path, 'k' FROM x WHERE d % 7 = 0 UNION ALL SELECT repo, path, 'payload.note' FROM x WHERE d % 13 = 0)""",
)
def code_reads(spark, sf):
    return readers.code_reads(files(spark, sf))


_OWN = [
    (0, "*", ["@all"]), (1, "*.ts", ["@ts"]), (2, "/src/", ["@src"]), (3, "lib/**/en/*", ["@lib-en"]), (4, "docs", ["@docs", "@writers"]),
    (5, "src/app/*/f*5.yml", ["@five"]),
]


@query(
    "code_owners",
    f"""WITH {_C} SELECT repo, path, CASE WHEN regexp_matches(path, '^src/app/[^/]*/f[^/]*5[.]yml$') THEN '@five' WHEN starts_with(path, 'docs/') THEN '@docs,@writers' WHEN regexp_matches(path, '^lib/(.*/)?en/[^/]*$') THEN '@lib-en'
    WHEN starts_with(path, 'src/') THEN '@src' WHEN path LIKE '%.ts' THEN '@ts' ELSE '@all' END AS owners FROM c""",
)
def code_owners(spark, sf):
    rules = spark.createDataFrame(_OWN, "rule_no int, pattern string, owners array<string>")
    return readers.owners_for(w.code_files(spark, sf), rules).select("repo", "path", F.array_join("owners", ",").alias("owners"))


@query(
    "ignored_files",
    f"""WITH {_C} SELECT repo, path, CASE WHEN contains(path, '/test/') THEN 'test' WHEN path LIKE '%.md' THEN '*.md' ELSE 'docs/**' END AS pattern FROM c WHERE contains(path, '/test/') OR path LIKE '%.md' OR starts_with(path, 'docs/')""",
)
def ignored_files(spark, sf):
    patterns = spark.createDataFrame([(0, "test"), (1, "*.md"), (2, "docs/**")], "pos int, pattern string")
    return readers.apply_ignores(w.code_files(spark, sf), patterns)[1]


@query(
    "kept_files",
    f"WITH {_C} SELECT d AS doc_id FROM c WHERE NOT (contains(path, '/test/') OR path LIKE '%.md' OR starts_with(path, 'docs/'))",
)
def kept_files(spark, sf):
    patterns = spark.createDataFrame([(0, "test"), (1, "*.md"), (2, "docs/**")], "pos int, pattern string")
    return readers.apply_ignores(w.code_files(spark, sf), patterns)[0].select("doc_id")


# One rule per part, of six kinds; files are named f<number>.
_MANY = """CASE p_partkey % 6 WHEN 0 THEN concat('f', p_partkey, '.*') WHEN 1 THEN concat('/src/**/f', p_partkey, '.ts')
  WHEN 2 THEN concat('f', p_partkey, '*') WHEN 3 THEN concat('*', p_partkey, '.yml') WHEN 4 THEN concat('lib/api/*/f', p_partkey, '.*')
  ELSE concat('*f', p_partkey, '*') END"""


@query(
    "many_rules",
    """WITH f AS (SELECT doc_id AS d, CAST(doc_id AS VARCHAR) AS s, CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'src/test/' WHEN 4 THEN 'lib/api/' WHEN 5 THEN 'src/app/' ELSE '' END AS dir,
      CASE doc_id % 5 WHEN 0 THEN '.yml' WHEN 1 THEN '.md' ELSE '.ts' END AS ext FROM documents),
    k AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s FROM part),
    hit AS (
      SELECT k, d FROM k JOIN f ON k = d WHERE k % 6 = 0 OR (k % 6 = 1 AND dir LIKE 'src/%' AND ext = '.ts') OR (k % 6 = 4 AND dir = 'lib/api/')
      UNION ALL SELECT k, d FROM k JOIN f ON starts_with(f.s, k.s) WHERE k % 6 IN (2, 5)
      UNION ALL SELECT k, d FROM k JOIN f ON ends_with(f.s, k.s) WHERE k % 6 = 3 AND ext = '.yml')
    SELECT k AS rule_no, count(*) AS files, max(d) AS last_file FROM hit GROUP BY k""",
)
def many_rules(spark, sf):
    """Files by rule, with as many rules as parts."""
    rules = w.table(spark, sf, "part").selectExpr("p_partkey AS rule_no", f"{_MANY} AS pattern")
    hits = join_globs(w.code_files(spark, sf).select("doc_id", "path"), "path", rules, over_paths=True)
    return hits.groupBy("rule_no").agg(F.count("*").alias("files"), F.max("doc_id").alias("last_file"))


@query(
    "first_mention",
    """WITH m AS (SELECT 'type-' || p_partkey % 40 AS event_type, l_orderkey, l_linenumber, l_shipdate, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey),
    f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY l_shipdate, l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS rn FROM m)
    SELECT event_type, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS sha, CASE l_orderkey % 3 WHEN 0 THEN l_orderkey WHEN 1 THEN l_partkey END AS pull_number FROM f WHERE rn = 1""",
)
def first_mention(spark, sf):
    li = w.table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    order, part = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    commits = li.select(
        key.alias("sha"), F.col("l_shipdate").alias("at"), F.lit("x").alias("author"),
        F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("Merge pull request #"), order, F.lit(" from a/b")))
        .when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit("feat: event (#"), part, F.lit(")")))
        .otherwise(F.concat(F.lit("chore (#"), part, F.lit(") more"))).alias("subject"),
        F.array(F.concat(F.lit("type-"), (F.col("l_partkey") % 40).cast("string"))).alias("event_types"),
    )
    types = w.table(spark, sf, "part").select(F.concat(F.lit("type-"), (F.col("p_partkey") % 40).cast("string")).alias("event_type"))
    return readers.first_mention(commits, types).select("event_type", "sha", "pull_number")


@query(
    "best_origin",
    f"""WITH {_C} SELECT source, event_type, path, role = 'publisher' AS publisher FROM (SELECT *, row_number() OVER (PARTITION BY source, event_type ORDER BY CASE role WHEN 'publisher' THEN 0 WHEN 'consumer' THEN 1 ELSE 2 END, repo, path) AS rn
    FROM roles WHERE NOT incidental) WHERE rn = 1""",
)
def best_origin(spark, sf):
    return readers.best_origin(files(spark, sf)).select("source", "event_type", "path", "publisher")


# --- routing and tickets ------------------------------------------------------------------------

_ROUTES = [
    (0, "*", "", "Bug"), (1, "src1*", "ONE", "Task"), (2, "SRC12", "TWELVE", None), (3, "src*9", "NINE", "Bug"), (4, "src1?", "NEVER", "Bug"),
    (5, "src1*", "LATER", "Story"),
]
_OWNERS = [(0, "@team-2*", "TEAM2", "Bug"), (1, "@team-*", "TEAMS", ""), (2, "svc/*", "REPO", None)]


def _findings(spark, sf):
    """One finding per document: its producer, the team that owns it, and the field it is about."""
    return w.table(spark, sf, "documents").select(
        F.col("doc_id"),
        F.concat("source", F.lit("@"), "lang").alias("name"), "source", F.col("lang").alias("event_type"),
        F.when(F.col("doc_id") % 4 != 0, F.array(F.concat(F.lit("@team-"), (F.col("doc_id") % 30).cast("string")))).alias("owners"),
        F.when(F.col("doc_id") % 8 == 0, "svc/ledger").otherwise("other").alias("repo"),
        F.concat(F.lit("neverSeen:f"), (F.col("doc_id") % 9).cast("string"), F.lit("[].id x")).alias("key"),
        F.concat(F.lit("f"), (F.col("doc_id") % 9).cast("string"), F.lit("[].id x")).alias("path"),
        F.concat(F.lit("`f` is odd in "), "lang").alias("summary"),
        F.col("n_chars").alias("affected"), (F.col("n_chars") + 10).alias("sampled"), (F.col("doc_id") % 5 == 0).alias("rejects"),
    )


def _routed(spark, sf):
    routes = spark.createDataFrame(_ROUTES, "pos int, pattern string, project string, issue_type string")
    owners = spark.createDataFrame(_OWNERS, "pos int, pattern string, project string, issue_type string")
    return routing.route(_findings(spark, sf), routes, owners, "DEF")


_ROUTE = """fr AS (SELECT doc_id AS d, source AS src, lang, n_chars, CASE WHEN source = 'src12' THEN 'TWELVE' WHEN source LIKE 'src%9' THEN CASE WHEN source LIKE 'src1%' THEN 'LATER' ELSE 'NINE' END WHEN source LIKE 'src1%' THEN 'LATER'
  WHEN doc_id % 8 = 0 THEN 'REPO' WHEN doc_id % 4 = 0 THEN 'DEF' WHEN CAST(doc_id % 30 AS VARCHAR) LIKE '2%' THEN 'TEAM2' ELSE 'TEAMS' END AS project FROM documents)"""


@query(
    "route_findings",
    f"""WITH {_ROUTE} SELECT d AS doc_id, project, CASE project WHEN 'LATER' THEN 'Story' ELSE 'Bug' END AS issue_type,
    CASE project WHEN 'TWELVE' THEN 'SRC12' WHEN 'LATER' THEN 'src1*' WHEN 'NINE' THEN 'src*9' WHEN 'TEAM2' THEN '@team-2*' WHEN 'TEAMS' THEN '@team-*' WHEN 'REPO' THEN 'svc/*' END AS rule FROM fr""",
)
def route_findings(spark, sf):
    return _routed(spark, sf).select("doc_id", "project", "issue_type", "rule")


@query(
    "route_patterns",
    """WITH s AS (SELECT DISTINCT source || CASE WHEN n_chars % 2 = 0 THEN '-x' ELSE '.y' END AS source FROM documents), h AS (SELECT regexp_split_to_array(source, '[-. ]')[1] AS head FROM s)
    SELECT CAST(0 AS INTEGER) AS band, head || '-*' AS pattern FROM h GROUP BY head HAVING count(*) > 1 UNION ALL SELECT 1, source FROM s""",
)
def route_patterns(spark, sf):
    src = F.concat("source", F.when(F.col("n_chars") % 2 == 0, "-x").otherwise(".y"))
    return routing.suggest_patterns(w.table(spark, sf, "documents").select(src.alias("source")))


_ID = """fi AS (SELECT doc_id AS d, source AS src, lang, doc_id % 9 AS f, 'contract-drift-' || left(sha1('prd|' || source || '@' || lang || '|neverSeen:f' || doc_id % 9 || '[].id x'), 12) AS fingerprint,
  'contract-drift,prd-global-bus,' || source || ',' || lang || ',f' || doc_id % 9 || '.id-x' AS identity FROM documents)"""


@query("finding_identity", f"WITH {_ID} SELECT d AS doc_id, fingerprint, identity FROM fi")
def finding_identity(spark, sf):
    named = routing.identify(_findings(spark, sf), "prd")
    return named.select("doc_id", "fingerprint", F.array_join("identity", ",").alias("identity"))


# Tickets out of orders: a third carry the labels of a finding, a few only its fingerprint.
_T = """t AS (SELECT 'T-' || o_orderkey AS ticket, epoch_ms(o_orderdate) AS created, o_orderstatus = 'F' AS done, 'src' || o_orderkey % 20 AS src, ['de', 'en', 'fr', 'es'][1 + (o_orderkey // 20) % 4] AS lang, (o_orderkey // 80) % 9 AS f, o_orderkey % 3 <> 0 AS labelled, o_orderkey % 30 = 0 AS printed FROM orders)"""


def _tickets(spark, sf):
    k = "o_orderkey"
    lang = f"element_at(array('de', 'en', 'fr', 'es'), cast(1 + floor({k} / 20) % 4 AS int))"
    src = f"concat('src', cast({k} % 20 AS string))"
    f = f"cast(floor({k} / 80) % 9 AS string)"
    fp = f"concat('contract-drift-', left(sha1(concat('prd|', {src}, '@', {lang}, '|neverSeen:f', {f}, '[].id x')), 12))"
    return w.table(spark, sf, "orders").selectExpr(
        f"concat('T-', cast({k} AS string)) AS ticket",
        "unix_millis(cast(o_orderdate AS timestamp)) AS created",
        "o_orderstatus = 'F' AS done",
        f"concat(array('contract-drift', 'prd-global-bus'), if({k} % 3 <> 0, array({src}, {lang}, concat('f', {f}, '.id-x')), array({src})),"
        f" if({k} % 30 = 0, array({fp}), cast(array() AS array<string>))) AS labels",
    )


_MT = f"""{_ID}, {_T}, best AS (SELECT src, lang, f, arg_min(ticket, (-created, ticket)) AS ticket FROM t WHERE NOT done AND (labelled OR printed) GROUP BY ALL)"""


@query(
    "ticket_matches",
    f"WITH {_MT} SELECT d AS doc_id, ticket FROM fi LEFT JOIN best USING (src, lang, f)",
)
def ticket_matches(spark, sf):
    found = routing.match_tickets(routing.identify(_findings(spark, sf), "prd"), _tickets(spark, sf))
    return found.select("doc_id", "ticket")


@query(
    "filing_plan",
    f"""WITH {_MT}, {_ROUTE} SELECT d AS doc_id, CASE WHEN ticket IS NOT NULL AND f <> 4 THEN 'skipped' WHEN project = 'DEF' THEN 'failed' WHEN ticket IS NOT NULL THEN 'commented' ELSE 'created' END AS outcome
    FROM fi LEFT JOIN best USING (src, lang, f) JOIN fr USING (d)""",
)
def filing_plan(spark, sf):
    routed = _routed(spark, sf).withColumn("project", F.when(F.col("project") != "DEF", F.col("project")))
    rows = routing.match_tickets(routing.identify(routed, "prd"), _tickets(spark, sf))
    comments = rows.where("path = 'f4[].id x'").select("fingerprint")
    return routing.filing_plan(rows, comments).select("doc_id", "outcome")


_TC = f"{_T}, n AS (SELECT DISTINCT source AS src, lang FROM documents), tc AS (SELECT src || '@' || lang AS name, t.* FROM n JOIN t USING (src, lang) WHERE labelled)"


def _by_contract(spark, sf):
    names = _findings(spark, sf).select("name").distinct()
    return routing.tickets_by_contract(_tickets(spark, sf), names)


@query("tickets_by_contract", f"WITH {_TC} SELECT name, ticket, done FROM tc")
def tickets_by_contract(spark, sf):
    return _by_contract(spark, sf).select("name", "ticket", "done")


@query(
    "ticket_by_path",
    f"WITH {_TC}, p AS (SELECT DISTINCT source || '@' || lang AS name, doc_id % 9 AS f FROM documents) SELECT name, 'f' || f || '[].id x' AS path, arg_min(ticket, (done, -created, ticket)) AS ticket FROM tc JOIN p USING (name, f) GROUP BY ALL",
)
def ticket_by_path(spark, sf):
    paths = _findings(spark, sf).select("name", "path").distinct()
    covers = routing.ticket_covers(_by_contract(spark, sf), paths)
    return routing.ticket_by_path(covers).select("name", "path", "ticket")


@query(
    "finding_rollup",
    """SELECT source || '@' || lang AS name, source, lang AS event_type, count(*) AS findings, count_if(doc_id % 5 = 0) AS rejecting,
    '[' || source || '] ' || CASE WHEN count(*) = 1 THEN 'f is odd in ' || lang ELSE lang || ', contract findings: ' || count(*) || CASE count_if(doc_id % 5 = 0) WHEN 0 THEN '' ELSE ', rejecting: ' || count_if(doc_id % 5 = 0) END END AS title,
    'Seen again in a day: ' || CASE WHEN count(*) = 1 THEN '' ELSE count(*) || ' findings, at most ' END || max(n_chars) || ' in ' || max(n_chars) + 10 || ' events' AS recurrence
    FROM documents GROUP BY source, lang""",
)
def finding_rollup(spark, sf):
    return routing.rollup(_findings(spark, sf), "a day")


# --- topology and application log ---------------------------------------------------------------


def _buses(spark, sf):
    s = w.table(spark, sf, "supplier")
    declared = s.where("s_suppkey % 3 <> 0").select(
        F.concat(F.lit("bus-"), F.col("s_suppkey").cast("string")).alias("bus"), F.when(F.col("s_suppkey") % 2 == 0, "prd").otherwise("dev").alias("stage")
    )
    name = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("prd-"), F.col("s_suppkey").cast("string"))).when(
        F.col("s_suppkey") == 1, "default"
    ).otherwise(F.concat(F.lit("bus-"), F.col("s_suppkey").cast("string")))
    live = s.where("s_suppkey % 4 <> 0 OR s_suppkey % 10 = 0").select(
        name.alias("bus"),
        F.concat(F.lit("arn:aws:events:r"), F.col("s_nationkey").cast("string"), F.lit(":"), (F.col("s_suppkey") % 2 * 111).cast("string"), F.lit(":event-bus/x")).alias("arn"),
        F.expr(
            "transform(filter(array(1, 2), i -> i <= s_suppkey % 3), i -> named_struct('name', concat('rule', cast(i AS string)), 'state', 'ENABLED', 'pattern', '{}',"
            " 'targets', if(i = 1, array(named_struct('id', 't1', 'arn', 'arn:aws:lambda:r:1:f'), named_struct('id', 't2', 'arn', 'arn:aws:sqs:r:1:q')), array())))"
        ).alias("rules"),
    )
    return declared, live


@query(
    "topology_drift",
    """WITH d AS (SELECT 'bus-' || s_suppkey AS bus FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0),
    l AS (SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'prd-' || s_suppkey WHEN s_suppkey = 1 THEN 'default' ELSE 'bus-' || s_suppkey END AS bus FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 10 = 0)
    SELECT 'declared_only' AS side, bus FROM d ANTI JOIN l USING (bus) UNION ALL SELECT 'live_only', bus FROM l ANTI JOIN d USING (bus) WHERE bus NOT LIKE 'prd-%' AND bus <> 'default'""",
)
def topology_drift(spark, sf):
    return topology.topology_drift(*_buses(spark, sf), "prd")


@query(
    "topology_targets",
    """WITH l AS (SELECT s_suppkey AS k, s_nationkey AS n, CASE WHEN s_suppkey % 10 = 0 THEN 'prd-' || s_suppkey WHEN s_suppkey = 1 THEN 'default' ELSE 'bus-' || s_suppkey END AS bus FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 10 = 0)
    SELECT bus, 'r' || n AS region, CAST(k % 2 * 111 AS VARCHAR) AS account, NULL AS rule, NULL AS target, NULL AS service FROM l WHERE k % 3 = 0
    UNION ALL SELECT bus, 'r' || n, CAST(k % 2 * 111 AS VARCHAR), 'rule1', t, s FROM l, (VALUES ('t1', 'lambda'), ('t2', 'sqs')) x(t, s) WHERE k % 3 >= 1
    UNION ALL SELECT bus, 'r' || n, CAST(k % 2 * 111 AS VARCHAR), 'rule2', NULL, NULL FROM l WHERE k % 3 = 2""",
)
def topology_targets(spark, sf):
    return topology.topology_targets(_buses(spark, sf)[1]).drop("state")


def _log_lines(spark, sf):
    return w.table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE WHEN event_id % 23 = 0 THEN concat('panic at line ', cast(event_id AS string)) ELSE concat('[2024-01-01T', lpad(cast(event_id AS string), 9, '0'), 'Z][',"
        " CASE event_id % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' WHEN 2 THEN 'DEBUG' WHEN 3 THEN 'FATAL' ELSE 'INFO' END, '][',"
        " if(event_id % 10 = 7, '', event_type), '] ok\n', props) END AS value",
    )


_LOG = """lg AS (SELECT event_id AS e, event_id % 23 = 0 AS raw, CASE WHEN event_id % 23 = 0 THEN NULL ELSE CASE event_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' WHEN 2 THEN 'debug' WHEN 3 THEN NULL ELSE 'info' END END AS level,
  CASE WHEN event_id % 23 = 0 OR event_id % 10 = 7 THEN NULL ELSE event_type END AS category, props FROM events)"""


@query(
    "log_parse",
    f"WITH {_LOG} SELECT e AS event_id, level, category, CASE WHEN raw THEN 'panic at line ' || e ELSE 'ok' || chr(10) || props END AS message FROM lg",
)
def log_parse(spark, sf):
    return applog.parse_log(_log_lines(spark, sf)).select("event_id", "level", "category", "message")


@query(
    "log_counts",
    f"WITH {_LOG} SELECT 'level' AS by, coalesce(level, '(none)') AS value, count(*) AS lines FROM lg GROUP BY ALL UNION ALL SELECT 'category', coalesce(category, '(none)'), count(*) FROM lg GROUP BY ALL",
)
def log_counts(spark, sf):
    lines = applog.parse_log(_log_lines(spark, sf))
    parts = [
        applog.log_counts(lines, by).select(F.lit(by).alias("by"), F.col(by).alias("value"), "lines") for by in ("level", "category")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "log_filter",
    f"""WITH {_LOG} SELECT e AS event_id FROM lg WHERE category IN ('view', 'error') AND level IN ('error', 'warn') AND contains(props, '7')""",
)
def log_filter(spark, sf):
    lines = applog.parse_log(_log_lines(spark, sf))
    return applog.filter_log(lines, ("view", "error"), "warn", "7", text_col="message").select("event_id")


@query(
    "log_tail",
    f"WITH {_LOG} SELECT e AS event_id FROM lg WHERE NOT raw ORDER BY e DESC LIMIT 40",
)
def log_tail(spark, sf):
    lines = applog.parse_log(_log_lines(spark, sf)).where("timestamp IS NOT NULL")
    return applog.tail_log(lines, 40).select("event_id")


# --- watches ------------------------------------------------------------------------------------

WATCHES = [
    Watch("all-retries", conditions=(Condition("status", "held"),), label="Retries"),
    Watch("portal", source="harbour*", event_type="view", conditions=(Condition("shipperId", "c-1*6"), Condition("amount", "null", "ne"))),
    Watch("numbers", conditions=(Condition("k", "42"), Condition("$.account", '"1001"'))),
    Watch("second-item", conditions=(Condition("items[1].sku", "s2"), Condition("detail.beta", "true")), notify=False),
    Watch("nulls", source="billing-invoices", conditions=(Condition("cargo", "null"),)),
    Watch("everything-click", event_type="click"),
    Watch("off", enabled=False),
]

_HITS = """hits AS (
  SELECT 'all-retries' AS watch_id, * FROM bus WHERE status = 'held'
  UNION ALL SELECT 'portal', * FROM bus WHERE src = 'harbour-desk' AND t = 'view' AND client = 'string' AND CAST(u AS VARCHAR) LIKE '1%6' AND amount <> 'null'
  UNION ALL SELECT 'numbers', * FROM bus WHERE k = 42 AND u % 3 = 1
  UNION ALL SELECT 'second-item', * FROM bus WHERE n = 2 AND beta
  UNION ALL SELECT 'nulls', * FROM bus WHERE src = 'billing-invoices' AND meta = 'null'
  UNION ALL SELECT 'everything-click', * FROM bus WHERE t = 'click')"""


def _hits(spark, sf):
    return wa.match_watches(w.bus(spark, sf), WATCHES)


@query("watch_hits", sql("bus", "SELECT watch_id, e AS event_id FROM hits", _HITS))
def watch_hits(spark, sf):
    return _hits(spark, sf).select("watch_id", "event_id")


@query(
    "watch_backfill",
    sql("bus", f"SELECT watch_id, e AS event_id, ms < {START_MS + 10 * DAY} AS backfill FROM hits WHERE ms >= {START_MS + 10 * DAY - 3600000}", _HITS),
)
def watch_backfill(spark, sf):
    return wa.backfill(w.bus(spark, sf), WATCHES, at(10 * DAY)).select("watch_id", "event_id", "backfill")


@query(
    "watch_resume",
    sql("bus", f"""SELECT count(*) FILTER (ms >= {START_MS + 12 * DAY - 3600000} AND ms <= {START_MS + 12 * DAY}) AS read,
    count(*) FILTER (ms >= {START_MS + 11 * DAY} AND ms < {START_MS + 12 * DAY - 3600000}) AS skipped FROM bus"""),
)
def watch_resume(spark, sf):
    window, lost = wa.resume_window(w.bus(spark, sf), at(11 * DAY), at(12 * DAY))
    return window.agg(F.count("*").alias("read")).crossJoin(lost.select(F.col("skipped_events").alias("skipped")))


@query(
    "watch_probe",
    sql("bus", f"SELECT src || '@' || t AS event_key, count(*) AS hits, max(ms) AS last_at FROM bus WHERE status = 'held' AND ms >= {START_MS + 18 * DAY} AND ms < {START_MS + 20 * DAY} GROUP BY ALL"),
)
def watch_probe(spark, sf):
    found = wa.probe(w.bus(spark, sf), WATCHES[0], at(20 * DAY), 48)
    return found.withColumn("last_at", ms("last_at"))


@query(
    "watch_dedup",
    sql("bus", "SELECT watch_id, e AS event_id FROM hits WHERE e % 4 <> 0", _HITS),
)
def watch_dedup(spark, sf):
    hits = _hits(spark, sf)
    again = hits.unionByName(hits.where("event_id % 3 = 0"))
    return wa.dedup_hits(again, hits.where("event_id % 4 = 0")).select("watch_id", "event_id")


@query(
    "watch_grades",
    sql("viol", """, gr AS (SELECT DISTINCT src, t, e FROM bus WHERE status = 'held' OR k = 42),
    bad_ AS (SELECT DISTINCT name, e FROM viol), odd AS (SELECT DISTINCT name, e FROM g WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.name = g.name AND d.path = g.path)
      UNION SELECT DISTINCT g.name, e FROM g JOIN declared d ON d.name = g.name AND d.path = g.path WHERE d.required AND g.v = '""' UNION SELECT name, e FROM wrong UNION SELECT name, e FROM outside)
    SELECT e AS event_id, CASE WHEN src = 'billing-invoices' AND t = 'error' THEN 'unknown' WHEN src = 'billing-ledger' AND t = 'Purchase' THEN 'missing' WHEN m.name IS NULL THEN 'missing' WHEN b.e IS NOT NULL THEN 'failing' WHEN o.e IS NOT NULL THEN 'drifting' ELSE 'ok' END AS grade
    FROM gr LEFT JOIN matched m USING (src, t) LEFT JOIN bad_ b USING (name, e) LEFT JOIN odd o USING (name, e)""").replace("\n, gr AS", ",\ngr AS"),
)
def watch_grades(spark, sf):
    hits = wa.match_watches(
        w.bus(spark, sf), [Watch("r", conditions=(Condition("status", "held"),)), Watch("k", conditions=(Condition("k", "42"),))]
    )
    return wa.grade_hits(hits, w.bus_contracts(spark)).select("event_id", "grade").distinct()


@query(
    "watch_digest",
    sql("bus", f"""SELECT watch_id, CAST(pos AS INTEGER) AS pos, hits, CASE WHEN hits > 3 THEN hits || ' events matched · latest: ' ELSE '' END || src || ' · ' || t || CASE watch_id WHEN 'all-retries' THEN ' · status=held' WHEN 'nulls' THEN ' · cargo=null' ELSE '' END AS body FROM (
    SELECT *, count(*) OVER (PARTITION BY watch_id) AS hits, row_number() OVER (PARTITION BY watch_id ORDER BY ts DESC, e) AS pos FROM hits WHERE watch_id IN ('all-retries', 'nulls', 'everything-click') AND ms >= {START_MS + 5 * DAY} AND ms < {START_MS + 5 * DAY + 7200000})
    WHERE pos = 1 OR (hits <= 3 AND pos <= 3)""", _HITS),
)
def watch_digest(spark, sf):
    window = scan_events(w.bus(spark, sf), at(5 * DAY), at(5 * DAY + 7200000))
    chosen = [x for x in WATCHES if x.id in ("all-retries", "nulls", "everything-click")]
    return wa.hit_digest(wa.match_watches(window, chosen), chosen).select("watch_id", "pos", "hits", "body")


def _marks(spark, sf):
    """Start and stop marks per environment out of orders: a log bounded by retention."""
    k = F.col("o_orderkey")
    return w.table(spark, sf, "orders").select(
        F.concat(F.lit("env"), (k % 3).cast("string")).alias("env"),
        F.concat(F.lit("m"), k.cast("string")).alias("mark_id"),
        F.when(F.floor(k / 3) % 3 == 1, "stop").otherwise("start").alias("kind"),
        (F.lit(START_MS) + (k * 7919) % (30 * 24 * 3600) * 1000).alias("at"),
    )


def _stored(spark, sf):
    """Hits as stored: environment, instant, receipt, grade."""
    return _hits(spark, sf).select(
        F.concat(F.lit("env"), (F.col("event_id") % 3).cast("string")).alias("env"), "watch_id", "event_id",
        ms().alias("at"), (ms() + 60000).alias("received_at"), (F.col("event_id") % 4 == 0).alias("backfill"),
        F.when(F.col("event_id") % 5 == 0, "failing").when(F.col("event_id") % 5 == 1, "drifting").when(F.col("event_id") % 5 == 2, "missing").otherwise("ok").alias("grade"),
    )


_SESS = _HITS + f""",
st AS (SELECT 'env' || e % 3 AS env, watch_id, e, ms AS ats, ms + 60000 AS received_at, e % 4 = 0 AS backfill, e % 5 < 3 AS problem FROM hits),
mk AS (SELECT 'env' || o_orderkey % 3 AS env, 'm' || o_orderkey AS mark_id, CASE WHEN (o_orderkey // 3) % 3 = 1 THEN 'stop' ELSE 'start' END AS kind, {START_MS} + (o_orderkey * 7919) % 2592000 * 1000 AS ats FROM orders),
nx AS (SELECT *, lead(ats) OVER w AS next_at, lead(kind) OVER w AS next_kind, min(CASE WHEN kind = 'stop' THEN ats END) OVER (PARTITION BY env ORDER BY ats, mark_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop_at
  FROM mk WINDOW w AS (PARTITION BY env ORDER BY ats, mark_id))"""


@query(
    "watch_sessions",
    sql("bus", """SELECT n.env, n.mark_id, n.ats AS started_at, CASE WHEN n.next_kind = 'stop' THEN n.next_at - n.ats END AS watched_ms, count(*) AS hits
    FROM nx n JOIN st h ON h.env = n.env AND h.ats >= n.ats AND (n.next_at IS NULL OR h.ats <= n.next_at) WHERE n.kind = 'start' GROUP BY ALL""", _SESS),
)
def watch_sessions(spark, sf):
    return wa.watch_sessions(_stored(spark, sf), _marks(spark, sf)).drop("live")


@query(
    "surviving_marks",
    sql("bus", """, keep AS (SELECT DISTINCT n.env, n.mark_id, n.stop_at FROM nx n JOIN st h ON h.env = n.env AND h.ats >= n.ats AND (n.stop_at IS NULL OR h.ats <= n.stop_at) WHERE n.kind = 'start')
    SELECT env, mark_id FROM keep UNION SELECT m.env, m.mark_id FROM mk m JOIN keep k ON k.env = m.env AND k.stop_at = m.ats WHERE m.kind = 'stop'""", _SESS).replace("\n, keep AS", ",\nkeep AS"),
)
def surviving_marks(spark, sf):
    return wa.surviving_marks(_marks(spark, sf), _stored(spark, sf))


@query(
    "watch_activity",
    sql("bus", f"""SELECT env, watch_id, count(*) AS hits, max(ats) AS latest, count_if(NOT backfill AND received_at > CASE env WHEN 'env2' THEN 0 ELSE {START_MS + 15 * DAY} END) AS unread, count_if(problem) AS problems FROM st GROUP BY ALL""", _SESS),
)
def watch_activity(spark, sf):
    seen = spark.createDataFrame([("env0", START_MS + 15 * DAY), ("env1", START_MS + 15 * DAY)], "env string, seen_at long")
    return wa.watch_activity(_stored(spark, sf), seen)


@query(
    "hit_retention",
    sql("bus", "SELECT env, e AS event_id, watch_id FROM (SELECT *, row_number() OVER (PARTITION BY env ORDER BY ats DESC, e, watch_id) AS rn FROM st) WHERE rn <= 300", _SESS),
)
def hit_retention(spark, sf):
    return wa.retain_hits(_stored(spark, sf), 300).select("env", "event_id", "watch_id")


@query(
    "mark_retention",
    sql("bus", "SELECT env, mark_id FROM (SELECT *, row_number() OVER (PARTITION BY env ORDER BY ats DESC, mark_id) AS rn FROM mk) WHERE rn <= 200", _SESS),
)
def mark_retention(spark, sf):
    return wa.retain_marks(_marks(spark, sf)).select("env", "mark_id")


@query(
    "watch_contracts",
    """WITH r AS (SELECT p_partkey AS k, 'svc-' || p_partkey % 7 AS src, 'type-' || p_partkey AS t FROM part)
    SELECT 'one' AS watch_id, src || '@' || t AS name FROM r WHERE src = 'svc-1' UNION ALL SELECT 'tens', src || '@' || t FROM r WHERE t LIKE 'type-1%0' UNION ALL SELECT 'any', src || '@' || t FROM r""",
)
def watch_contracts(spark, sf):
    rules = spark.createDataFrame([("one", "svc-1", ""), ("tens", None, "type-1*0"), ("any", "", None)], "watch_id string, source string, event_type string")
    return wa.watch_contracts(rules, w.part_registry(spark, sf))
