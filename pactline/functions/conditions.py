"""Watch conditions compiled to Column predicates on the event envelope."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactline.functions.globs import glob, glob_regex


@dataclass(frozen=True)
class Condition:
    """`path op value`, as typed by a person; `op` is `eq` or `ne`."""

    path: str
    value: str
    op: str = "eq"


@dataclass(frozen=True)
class Watch:
    """What to be told about. No clause at all takes every event."""

    id: str
    source: str | None = None
    event_type: str | None = None
    conditions: tuple[Condition, ...] = field(default_factory=tuple)
    label: str = ""
    enabled: bool = True
    notify: bool = True


def payload_path(path: str) -> str:
    """Path from the envelope: a bare path lives in `detail`, `$.x` names the envelope itself."""
    path = path.strip()
    if path.startswith("$"):
        return path.removeprefix("$").removeprefix(".")
    body = path.removeprefix(".")
    if not body or re.match(r"detail($|[.\[])", body):
        return body
    return f"detail{body}" if body.startswith("[") else f"detail.{body}"


def variant_path(path: str) -> str:
    """JSON path in bracket form, so any member name is legal."""
    out = "$"
    for segment in filter(None, payload_path(path).split(".")):
        name, *indexes = re.split(r"\[", segment)
        if name:
            quoted = name.replace("'", "\\'")
            out += f"['{quoted}']"
        for index in indexes:
            number = index.rstrip("]")
            out += f"[{int(number)}]" if number.isdigit() else f"['{number}']"
    return out


def lookup(envelope: Column, path: str) -> Column:
    """The VARIANT at a condition path; NULL when absent (a JSON null is not)."""
    if not payload_path(path):
        raise ValueError("a condition needs a field path")
    return F.try_variant_get(envelope, variant_path(path), "variant")


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def value_equals(v: Column, expected: str) -> Column:
    """Quoted is a string; true, false, null are themselves; a number compares as one; else a glob."""
    expected = expected.strip()
    text = F.try_variant_get(v, "$", "string")
    if len(expected) >= 2 and expected[0] == expected[-1] == '"':
        return _is_string(v) & glob(text, expected[1:-1])
    if expected in ("true", "false"):
        return (F.schema_of_variant(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == (expected == "true"))
    if expected == "null":
        return F.is_variant_null(v)
    try:
        number = float(expected)
    except ValueError:
        return _is_string(v) & (glob(text, expected) if "*" not in expected else text.rlike(glob_regex(expected)))
    is_number = F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return is_number & (F.abs(F.try_variant_get(v, "$", "double") - F.lit(number)) < 2.220446049250313e-16)


def condition_expr(cond: Condition, envelope: Column | None = None) -> Column:
    """TRUE or FALSE. `ne` holds only where the field is present and differs."""
    v = lookup(F.col("envelope") if envelope is None else envelope, cond.path)
    equal = F.coalesce(value_equals(v, cond.value), F.lit(False))
    return equal if cond.op == "eq" else v.isNotNull() & ~equal


def watch_expr(watch: Watch, envelope: Column | None = None) -> Column:
    """All clauses of one watch; source and type first, as they are plain columns."""
    out = F.lit(True)
    if (watch.source or "").strip():
        out = out & glob(F.col("source"), watch.source.strip())
    if (watch.event_type or "").strip():
        out = out & glob(F.col("event_type"), watch.event_type.strip())
    for cond in watch.conditions:
        if cond.path.strip():
            out = out & condition_expr(cond, envelope)
    return out


def summary(watch: Watch) -> str:
    """One line for lists."""
    parts = [p.strip() for p in (watch.source, watch.event_type) if p and p.strip()]
    sign = {"eq": "=", "ne": "≠"}
    parts += [f"{c.path.strip()} {sign[c.op]} {c.value.strip()}" for c in watch.conditions if c.path.strip()]
    return " · ".join(parts) or "every event"
