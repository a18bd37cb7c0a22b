"""Application log lines: parse, count, filter, tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The line format and the severity order.
LINE = r"(?s)^\[([^\]]*)\]\[([A-Z]+)\]\[([^\]]*)\]\s?(.*)$"
LEVELS = ("error", "warn", "info", "debug", "trace")
NONE = "(none)"


def parse_log(df: DataFrame, line_col: str = "value") -> DataFrame:
    """`timestamp, level, category, message` per line; a line of another form keeps its whole text."""
    line = F.col(line_col)
    matched = line.rlike(LINE)

    def group(i: int):
        text = F.when(matched, F.regexp_extract(line, LINE, i))
        return F.when(text != "", text)

    level = F.lower(group(2))
    return df.select(
        "*",
        line.alias("raw"),
        group(1).alias("timestamp"),
        F.when(level.isin(*LEVELS), level).alias("level"),
        group(3).alias("category"),
        F.when(matched, F.regexp_extract(line, LINE, 4)).otherwise(line).alias("message"),
    )


def log_counts(lines: DataFrame, by: str) -> DataFrame:
    """Lines per category or per level, the untagged under `(none)`."""
    return lines.groupBy(F.coalesce(by, F.lit(NONE)).alias(by)).agg(F.count("*").alias("lines"))


def filter_log(
    lines: DataFrame, categories=(), min_level: str | None = None, text: str = "", text_col: str = "raw"
) -> DataFrame:
    """Keep lines of a category set (empty = all), at least `min_level`, containing `text` in `text_col`."""
    cond = F.lit(True)
    if categories:
        cond = cond & F.coalesce("category", F.lit(NONE)).isin(*categories)
    if min_level is not None:
        cond = cond & F.col("level").isin(*LEVELS[: LEVELS.index(min_level) + 1])
    if text.strip():
        cond = cond & F.lower(text_col).contains(text.strip().lower())
    return lines.where(F.coalesce(cond, F.lit(False)))


def tail_log(lines: DataFrame, n: int, order_col: str = "timestamp") -> DataFrame:
    """Last `n` lines by `order_col` (a top-k), oldest first."""
    return lines.orderBy(F.desc(order_col)).limit(n).orderBy(order_col)
