"""Wording helpers shared by issues, reports and tickets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(count: Column, total: Column) -> Column:
    """Share as text; anything that happened at all reads as at least `1%`."""
    share = F.greatest(F.round(count * 100.0 / total).cast("bigint"), F.lit(1).cast("bigint"))
    return F.when((total == 0) | (count == 0), F.lit("0%")).otherwise(F.concat(share.cast("string"), F.lit("%")))


def clip(col: Column, limit: int = 140) -> Column:
    """Shorten to `limit` characters at a word boundary, with an ellipsis."""
    text = F.trim(col)
    head = F.left(text, F.lit(limit))
    cut = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    body = F.when(head.contains(" "), cut).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(body, F.lit("…")))


def field_label(path: Column) -> Column:
    """A field as it reads inside a sentence."""
    return F.when(path == "", F.lit("the payload")).otherwise(F.concat(F.lit("`"), path, F.lit("`")))


def plain(col: Column) -> Column:
    """Drop code marks."""
    return F.replace(col, F.lit("`"), F.lit(""))
