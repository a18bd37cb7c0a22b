"""Identity spellings of an event type: wire form, registrable form, title form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a registry accepts in a name, and what marks a field as an identifier.
LEGAL_NAME_CHARS = r"A-Za-z0-9_.\-@"
ID_FIELD_PATTERN = r"(?i)(id|ids|uuid|arn)$"


def event_key(source: Column, event_type: Column) -> Column:
    """Display form `source@event_type`."""
    return F.concat(source, F.lit("@"), event_type)


def sanitize_name(col: Column) -> Column:
    """Registrable spelling: illegal characters become `-`, runs of `-` collapse."""
    return F.regexp_replace(F.regexp_replace(col, f"[^{LEGAL_NAME_CHARS}]", "-"), "-{2,}", "-")


def detail_title(col: Column) -> Column:
    """PascalCase title of an event type: `order-placed` -> `OrderPlaced`."""
    parts = F.transform(
        F.split(col, "[-_. ]"), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))
    )
    return F.array_join(parts, "")


def invalid_chars(col: Column) -> Column:
    """Distinct characters a registry would refuse, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(f"([^{LEGAL_NAME_CHARS}])"), 1))


def is_id_like(col: Column) -> Column:
    """Names ending in id, ids, uuid or arn (so `paid` counts too)."""
    return col.rlike(ID_FIELD_PATTERN)


def split_identity(col: Column) -> tuple[Column, Column]:
    """`source`, `event_type` of a contract name, cut at the first `@`; NULL when either is empty."""
    at = F.locate("@", col)
    source = F.when(at > 1, F.substr(col, F.lit(1), at - 1))
    event_type = F.when((at > 1) & (at < F.length(col)), F.substr(col, at + 1))
    return F.when(event_type.isNotNull(), source), event_type


# Fixed value: the longest label a tracker takes.
LABEL_CHARS = 255
# Characters that have a meaning in a path, and how a member name spells them.
_IN_NAMES = (("%", "%25"), (".", "%2E"), ("[", "%5B"), ("*", "%2A"), ("\u0001", "%01"))


def label(col: Column) -> Column:
    """A ticket label: no `[]`, white space to `-`; a longer one is cut and ends in a hash of all of it."""
    text = F.regexp_replace(F.replace(F.trim(col), F.lit("[]"), F.lit("")), r"\s", "-")
    short = F.concat(F.left(text, F.lit(LABEL_CHARS - 13)), F.lit("-"), F.left(F.sha1(text.cast("binary")), F.lit(12)))
    return F.when(F.length(text) <= LABEL_CHARS, text).otherwise(short)


def path_step(name: Column) -> Column:
    """A member name as a step of a path: a dot or bracket of its own is spelled `%2E`, `%5B`, so paths stay distinct."""
    for char, code in _IN_NAMES:
        name = F.replace(name, F.lit(char), F.lit(code))
    return name


def path_step_sql(name: str) -> str:
    """`path_step` as SQL text."""
    for char, code in _IN_NAMES:
        name = f"replace({name}, '{char}', '{code}')"
    return name


def member_name(step: Column) -> Column:
    """The member name that a step of a path stands for."""
    for char, code in reversed(_IN_NAMES):
        step = F.replace(step, F.lit(code), F.lit(char))
    return step


def repeats(path: Column) -> Column:
    """Whether a path can occur more than once in one event: below an array, or a wildcard that stands for many members."""
    return path.contains("[]") | path.rlike(r"(^|\.)\*($|\.|\[)")
