"""The regular expression that all strings of a group share, when they share one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.session import cut

# How long a pattern may get, and what counts as a run.
MAX_TOKENS = 12
RUN = "[A-Za-z0-9]+"
_META = r"([.^$*+?()\[\]{}|\\])"


def common_pattern(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """`pattern` per group; no row where the strings differ in structure, are blank, or are one value.

    A value is runs and separators. Its structure (separators with the runs blanked out) and one
    small statistic per run are all that is shuffled: values are reduced map-side, never collected.
    """
    value = F.col(col)
    runs = F.regexp_extract_all(value, F.lit(f"({RUN})"), 1)
    # A run becomes one mark; what is left are the separators, each a token of its own. A value of
    # too many tokens has no shape, like a blank one, and rules its group out.
    marked = F.regexp_replace(value, RUN, "\u0001")
    shape = F.when(F.length(marked) <= MAX_TOKENS, marked).otherwise("")
    stats = df.where(value.isNotNull()).select(
        *keys,
        F.xxhash64(value).alias("_v"),
        shape.alias("_shape"),
        F.posexplode_outer(F.when(shape != "", runs)).alias("_pos", "_run"),
    )
    # Two steps follow on this reduced table; the values are read once.
    per_run = cut(stats.groupBy(*keys, "_shape", "_pos").agg(
        F.min(F.length("_run")).alias("lo"),
        F.max(F.length("_run")).alias("hi"),
        F.max(F.col("_run").rlike("[0-9]")).alias("digit"),
        F.max(F.col("_run").rlike("[a-z]")).alias("lower"),
        F.max(F.col("_run").rlike("[A-Z]")).alias("upper"),
        F.min(F.col("_run").rlike("^[0-9a-f]+$")).alias("hex"),
        F.min("_v").alias("_lo_v"),
        F.max("_v").alias("_hi_v"),
    ))
    # Structures are at most a few per conforming group; a group of many has no pattern, and
    # min = max tells that without collecting them.
    one = per_run.groupBy(*keys).agg(
        F.min("_shape").alias("_min"),
        F.max("_shape").alias("_max"),
        F.min("_lo_v").alias("_lo_v"),
        F.max("_hi_v").alias("_hi_v"),
    ).where("_min = _max AND _min <> '' AND _lo_v <> _hi_v")
    digit, lower, upper = F.col("digit"), F.col("lower"), F.col("upper")
    cls = (
        F.when(F.col("hex") & digit & lower & ~upper, "[0-9a-f]")
        .when(digit & ~lower & ~upper, "\\d")
        .when(lower & ~digit & ~upper, "[a-z]")
        .when(upper & ~digit & ~lower, "[A-Z]")
        .when(lower & upper & ~digit, "[A-Za-z]")
        .when(digit & lower & ~upper, "[0-9a-z]")
        .when(digit & upper & ~lower, "[0-9A-Z]")
        .otherwise("[0-9A-Za-z]")
    )
    lo, hi = F.col("lo"), F.col("hi")
    count = (
        F.when((lo == 1) & (hi == 1), F.lit(""))
        .when(lo == hi, F.format_string("{%d}", lo))
        .otherwise(F.format_string("{%d,%d}", lo, hi))
    )
    rendered = per_run.join(one.select(*keys, F.col("_min").alias("_shape")), [*keys, "_shape"]).select(
        *keys, "_shape", "_pos", F.concat(cls, count).alias("piece")
    )
    # At most MAX_TOKENS pieces per group.
    pieces = rendered.groupBy(*keys, "_shape").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("pos"), "piece"))), lambda p: p["piece"]
        ).alias("_pieces")
    )
    chars = F.filter(F.split("_shape", ""), lambda ch: ch != "")
    tokens = F.transform(
        chars,
        lambda ch, i: F.when(
            ch == "\u0001",
            F.get("_pieces", F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == "\u0001"))),
        ).otherwise(F.regexp_replace(ch, _META, r"\\$1")),
    )
    return pieces.select(*keys, F.concat(F.lit("^"), F.array_join(tokens, ""), F.lit("$")).alias("pattern"))
