"""Wildcard patterns compiled to anchored regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = r"([\\.\[\]{}()+?^$|])"


def glob_regex(pattern: str) -> str:
    """Anchored Java regex for a literal pattern in which `*` matches any run."""
    body = ".*".join(re.sub(_META, r"\\\1", part) for part in pattern.split("*"))
    return rf"(?s)^{body}\z"


def glob(col: Column, pattern: str) -> Column:
    """Case-sensitive anchored match; without `*` it is plain equality and can be pushed down."""
    if "*" not in pattern:
        return col == F.lit(pattern)
    if pattern.count("*") == 1 and pattern.endswith("*"):
        return col.startswith(pattern[:-1])
    return col.rlike(glob_regex(pattern))


def glob_regex_col(pattern: Column, ignore_case: bool = False) -> Column:
    """`glob_regex` for a column of patterns (rule tables)."""
    escaped = F.regexp_replace(pattern, _META, r"\\$1")
    flags = "(?is)^" if ignore_case else "(?s)^"
    return F.concat(F.lit(flags), F.regexp_replace(escaped, r"\*", ".*"), F.lit(r"\z"))


def specificity(pattern: Column) -> Column:
    """Literal characters in a pattern: what ranks two rules that both match."""
    return F.length(F.regexp_replace(pattern, r"\*", ""))


def path_glob_regex_col(pattern: Column) -> Column:
    """Regex for ownership and ignore patterns over `/`-separated paths.

    `*` stays inside one component, `**` spans any number; a slash anywhere but the end anchors
    the pattern at the root; a directory covers everything under it.
    """
    bare = F.regexp_replace(pattern, "^/+", "")
    anchored = pattern.startswith("/") | F.regexp_replace(bare, "/+$", "").contains("/")
    core = F.regexp_replace(bare, "/+$", "")
    rx = F.regexp_replace(core, _META, r"\\$1")
    rx = F.regexp_replace(rx, r"(^|/)\*\*(/|$)", "$1\u0001$2")
    rx = F.regexp_replace(rx, r"\*+", "[^/]*")
    rx = F.regexp_replace(rx, "/\u0001$", "(?:/.*)?")
    rx = F.regexp_replace(rx, "\u0001/", "(?:.*/)?")
    rx = F.regexp_replace(rx, "\u0001", ".*")
    head = F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?"))
    return F.when(pattern == "*", F.lit("^.*$")).otherwise(F.concat(head, rx, F.lit(r"(?:/.*)?\z")))
