"""Payloads to path observations, and the profile of every path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactline.functions.json_types import JSON_TYPES, blank_sql, type_sql
from pactline.functions.names import path_step_sql, repeats

# Fixed value: distinct values listed for a field.
VALUE_CAP = 32

_NODE = "struct<path:string,parent_path:string,type:string,value_json:string,is_blank:boolean>"


def _node_sql(v: str, path: str, parent: str, type_name: str, container_json: bool) -> str:
    text = f"to_json({v})"
    value = text if container_json else f"if({type_name} IN ('object', 'array'), NULL, {text})"
    return (
        f"named_struct('path', {path}, 'parent_path', {parent}, 'type', {type_name},"
        f" 'value_json', {value}, 'is_blank', {blank_sql(v, type_name)})"
    )


def _step_sql(name: str, parent: str, wild: str | None) -> str:
    """A member's step; `*` for one that its parent, a wildcard by the map `wild`, does not declare by name."""
    step = path_step_sql(name)
    return step if wild is None else f"if(coalesce(NOT array_contains(element_at({wild}, {parent}), {name}), false), '*', {step})"


def _depth_sql(text: str) -> str:
    """How deep the brackets of JSON text are nested, those inside strings left out; one pass that carries two numbers."""
    bare = f"replace(replace({text}, '\\\\\\\\', ''), '\\\\\"', '')"
    brackets = f"regexp_replace(regexp_replace({bare}, '\"[^\"]*+\"', ''), '[^\\\\[\\\\]{{}}]', '')"
    now = "a.now + CASE WHEN c IN ('{', '[') THEN 1 WHEN c IN ('}', ']') THEN -1 ELSE 0 END"
    return (
        f"aggregate(split({brackets}, ''), named_struct('now', 0, 'most', 0),"
        f" (a, c) -> named_struct('now', {now}, 'most', greatest(a.most, {now})), a -> a.most)"
    )


def _subtree_sql(v: str, path: str, type_name: str, container_json: bool, wild: str | None = None) -> str:
    """Every node below a container, any depth, inside one expression.

    Each step turns the frontier into its children. There are as many steps as the container is deep, and no more: each one
    copies what was found so far.
    """
    frontier = "array<struct<path:string,parent_path:string,v:variant,type:string>>"
    steps = f"2 + {_depth_sql(f'to_json({v})')}"
    members = (
        "transform(map_entries(try_variant_get(n.v, '$', 'map<string,variant>')), e -> named_struct("
        f"'path', concat(if(n.path = '', '', concat(n.path, '.')), {_step_sql('e.key', 'n.path', wild)}), 'parent_path', n.path,"
        f" 'v', e.value, 'type', {type_sql('e.value')}))"
    )
    elements = (
        "transform(try_variant_get(n.v, '$', 'array<variant>'), x -> named_struct("
        f"'path', concat(n.path, '[]'), 'parent_path', n.path, 'v', x, 'type', {type_sql('x')}))"
    )
    node = _node_sql("n.v", "n.path", "n.parent_path", "n.type", container_json)
    return (
        f"aggregate(sequence(1, {steps}),"
        f" named_struct('f', cast(array(named_struct('path', {path}, 'parent_path', '', 'v', {v}, 'type',"
        f" {type_name})) AS {frontier}), 'o', cast(array() AS array<{_NODE}>)),"
        f" (a, i) -> if(size(a.f) = 0, a, named_struct("
        f"'f', cast(flatten(transform(filter(a.f, n -> n.type IN ('object', 'array')),"
        f" n -> if(n.type = 'object', {members}, {elements}))) AS {frontier}),"
        f" 'o', cast(concat(a.o, transform(if(i = 1, filter(a.f, n -> false), a.f), n -> {node})) AS array<{_NODE}>))),"
        f" a -> a.o)"
    )


def _walk(
    events: DataFrame, keys: list[str], levels: int, expand: str, container_json: bool, wild: str | None = None, whole: bool = False
) -> DataFrame:
    """One pass over the payloads: `levels` generator steps, one per nesting level.

    A container leaves its own node with its first child (`_pend`), so no level is read twice.
    Afterwards each row holds one node in `_v` and the ancestors it still has to report. With `whole`, a wildcard parent is
    left unopened, as its members meet on one path.
    """
    spark = events.sparkSession
    empty = f"cast(array() AS array<{_NODE}>)"
    df = events.selectExpr(
        *keys, "detail AS _v", "'' AS _path", "'' AS _parent", f"{type_sql('detail')} AS _type", f"{empty} AS _pend",
        *([f"{wild} AS _wild"] if wild else []),
    ).where("_v IS NOT NULL")
    carried = ["_wild"] if wild else []
    opened = f"_type IN ({expand})" + (" AND element_at(_wild, _path) IS NULL" if wild and whole else "")
    self_node = _node_sql("_v", "_path", "_parent", "_type", container_json)
    for _ in range(levels):
        df = df.withColumn("_in", F.expr(f"if({opened}, _v, NULL)"))
        df = df.lateralJoin(spark.tvf.variant_explode_outer(F.col("_in").outer()).toDF("_pos", "_key", "_val"))
        df = df.selectExpr(
            *keys,
            "if(_pos IS NULL, _v, _val) AS _v",
            "CASE WHEN _pos IS NULL THEN _path WHEN _key IS NULL THEN concat(_path, '[]')"
            f" ELSE concat(if(_path = '', '', concat(_path, '.')), {_step_sql('_key', '_path', '_wild' if wild else None)}) END AS _path",
            "if(_pos IS NULL, _parent, _path) AS _parent",
            f"if(_pos IS NULL, _type, {type_sql('_val')}) AS _type",
            f"CASE WHEN _pos IS NULL THEN _pend WHEN _pos = 0 THEN array_append(_pend, {self_node})"
            f" ELSE {empty} END AS _pend",
            *carried,
        )
    return df


def observe(
    events: DataFrame,
    keys: tuple[str, ...] = ("event_id", "source", "event_type"),
    levels: int = 4,
    container_json: bool = False,
    include_root: bool = False,
    wild: str | None = None,
) -> DataFrame:
    """One row per occurrence of every path in `detail`; array steps collapse to `[]`.

    A dot inside a member name is spelled `%2E` (`names.path_step`), so it is no step. `wild` names a column that maps
    paths of objects to the members they declare by name (`clauses.Clauses.wild`): any other member there is the step `*`.

    No shuffle and no depth limit: payloads nested deeper than `levels` finish inside a row-local
    expression. Works on streams. `value_json` is canonical text, for scalars unless
    `container_json`; the payload itself (path '') only with `include_root`.
    """
    keys = list(keys)
    walked = _walk(events, keys, levels, "'object', 'array'", container_json, wild)
    rest = _subtree_sql("_v", "_path", "_type", container_json, "_wild" if wild else None)
    node = _node_sql("_v", "_path", "_parent", "_type", container_json)
    # `inline` interprets what it is given, so the node is made before it; and `concat` builds a lazy list there.
    nodes = walked.selectExpr(
        *keys, "_pend", f"{node} AS _self", f"if(_type IN ('object', 'array'), {rest}, cast(array() AS array<{_NODE}>)) AS _sub"
    )
    out = nodes.selectExpr(*keys, "inline(flatten(array(_pend, array(_self), _sub)))")
    return out if include_root else out.where("path <> ''")


def event_paths(
    events: DataFrame, keys: tuple[str, ...] = ("event_id", "source", "event_type"), levels: int = 4, wild: str | None = None
) -> DataFrame:
    """One row per (event, path): the set of types it held there and whether one was blank.

    Below an array, or a wildcard (`wild`, as in `observe`), a path can occur many times in one event. Arrays are therefore folded inside the
    row, which makes every later per-event count a plain `count(*)` with map-side partials instead
    of a distinct count that would ship each observation. The payload itself is path ''.
    """
    keys = list(keys)
    walked = _walk(events, keys, levels, "'object'", False, wild, whole=True)
    inner = "_wild" if wild else None
    below = walked.selectExpr(
        *keys,
        "_pend",
        f"{_node_sql('_v', '_path', '_parent', '_type', False)} AS _self",
        f"if(_type IN ('object', 'array'), {_subtree_sql('_v', '_path', '_type', False, inner)},"
        f" cast(array() AS array<{_NODE}>)) AS _sub",
    )
    # Strings, so that array_distinct hashes instead of comparing all pairs. Sorted, the marks of one path lie side by
    # side, and one pass over the places where the path changes folds them.
    sep = "\\u0001"
    mark = "concat_ws('{0}', n.path, n.parent_path, n.type, cast(n.is_blank AS string))".format(sep)
    marked = below.selectExpr(
        *keys,
        "concat(_pend, array(_self)) AS _once",
        f"sort_array(array_distinct(transform(_sub, n -> {mark}))) AS _marks",
    )
    path_of = "substring_index({0}, '{1}', 1)"
    changes = f"{path_of.format('get(_marks, i - 1)', sep)} <> {path_of.format('get(_marks, i - 2)', sep)}"
    starts = marked.selectExpr(
        *keys,
        "_once",
        "_marks",
        f"if(size(_marks) = 0, cast(array() AS array<int>), filter(sequence(1, size(_marks)), i -> i = 1 OR {changes})) AS _starts",
    )
    single = (
        "transform(_once, n -> named_struct('path', n.path, 'parent_path', n.parent_path,"
        " 'types', n.type, 'is_blank', n.is_blank))"
    )
    part = "split({0}, '" + sep + "')[{1}]"
    folded = (
        "transform(transform(_starts, (s, j) -> slice(_marks, s, coalesce(get(_starts, j + 1), size(_marks) + 1) - s)),"
        f" g -> named_struct('path', {part.format('g[0]', 0)}, 'parent_path', {part.format('g[0]', 1)},"
        f" 'types', array_join(sort_array(array_distinct(transform(g, m -> {part.format('m', 2)}))), ','),"
        f" 'is_blank', exists(g, m -> endswith(m, '{sep}true'))))"
    )
    return starts.selectExpr(*keys, f"inline(concat({single}, {folded}))")


def type_set_counts(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Events per (key, path, set of types): the only aggregate that sees every observation."""
    return paths.groupBy(*keys, "path", "parent_path", "types").agg(
        F.count("*").alias("n"), F.count_if("is_blank").alias("blank")
    )


def profile_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Fold type sets to one row per (key, path)."""
    per_type = {f"n_{t}": F.sum(F.when(F.array_contains(F.split("types", ","), t), F.col("n")).otherwise(0)) for t in JSON_TYPES}
    out = counts.groupBy(*keys, "path", "parent_path").agg(
        F.sum("n").alias("seen_in"),
        F.sum("blank").alias("blank_in"),
        F.sort_array(F.collect_list(F.struct(F.split("types", ",").alias("types"), "n"))).alias("type_sets"),
        *[c.cast("bigint").alias(name) for name, c in per_type.items()],
    )
    seen = F.filter(
        F.array(*[F.when(F.col(f"n_{t}") > 0, F.lit(t)) for t in JSON_TYPES]), lambda t: t.isNotNull()
    )
    return out.withColumn("types", seen)


def profile(
    events: DataFrame, keys: tuple[str, ...] = ("source", "event_type"), levels: int = 4
) -> DataFrame:
    """Presence, types, per-type event counts and blanks of every path; path '' counts the events."""
    keys = list(keys)
    facts = event_paths(events, tuple(keys), levels)
    return profile_from_counts(type_set_counts(facts, keys), keys)


def field_examples(obs: DataFrame, keys: list[str]) -> DataFrame:
    """First value of every (key, path, type) in (ts, event_id) order; `obs` carries both columns.

    Of several in one event, the one whose text comes first.
    """
    found = obs.groupBy(*keys, "path", "type").agg(
        F.min_by("value_json", F.struct("ts", "event_id", "value_json")).alias("_first"),
        # A sketch of the distinct values; it also keeps the aggregate hash-based.
        F.hll_sketch_estimate(F.hll_sketch_agg(F.coalesce("value_json", F.lit("")), 8)).alias("approx_values"),
    )
    # The example leans on the sketch, so that who drops the sketch does not get an aggregate that sorts all observations.
    return found.select(
        *keys, "path", "type", F.when(F.col("approx_values") >= 0, F.col("_first")).alias("example"), "approx_values"
    )


def value_counts(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Events per distinct scalar value of every path, exact and uncapped.

    Only a path below an array or a wildcard can repeat in one event, so only those keep the event in the key.
    """
    repeated = repeats(F.col("path"))
    once = (
        obs.where("type NOT IN ('object', 'array')")
        .groupBy(*keys, "path", "value_json", F.when(repeated, F.col("event_id")).alias("_event"))
        .agg(F.count("*").alias("_n"))
    )
    return once.groupBy(*keys, "path", "value_json").agg(
        F.sum(F.when(repeated, 1).otherwise(F.col("_n"))).cast("bigint").alias("events")
    )


def field_sample(obs: DataFrame, path: str, cap: int = VALUE_CAP) -> DataFrame:
    """Distinct scalar values at one path in first-seen order, at most `cap` listed.

    `distinct_values` is exact; `capped` says the list stops short. `obs` carries `ts`, `event_id`.
    """
    at = obs.where((F.col("path") == path) & ~F.col("type").isin("object", "array"))
    per_value = at.groupBy("value_json").agg(
        F.min(F.struct("ts", "event_id")).alias("first"), F.count("*").alias("occurrences")
    )
    total = per_value.agg(F.count("*").alias("distinct_values"))
    listed = per_value.orderBy("first", "value_json").limit(cap)
    order = W.partitionBy(F.lit(0)).orderBy("first", "value_json")
    # The total is one row, the list at most `cap` rows.
    return listed.withColumn("pos", F.row_number().over(order)).crossJoin(F.broadcast(total)).select(
        "pos",
        "value_json",
        "occurrences",
        "distinct_values",
        (F.col("distinct_values") > cap).alias("capped"),
    )


def field_coverage(fields: DataFrame, prof: DataFrame, keys: list[str]) -> DataFrame:
    """Events carrying each declared field, zero included."""
    declared = fields.where("depth > 0").select(*keys, "path", "required")
    return declared.join(prof.select(*keys, "path", "seen_in"), [*keys, "path"], "left").fillna(0, ["seen_in"])
