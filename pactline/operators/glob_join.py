"""Texts and wildcard rules joined by literals, so that no text is compared with every rule.

A rule is listed under one literal that every text it matches must hold. Its words are such literals: one without a wildcard
beside it is a whole word of the text, one with a wildcard after it starts a word, one with a wildcard before it ends one,
and one between wildcards lies in a word. So are what it starts or ends with and three letters of its longest literal piece.
Of these it takes the one that fewest rules hold, so that an extension that all share is no meeting place. A text lists its
words and the starts, ends and insides of words of the lengths that the rules are listed under. The two meet in an equi join,
and the rule's regular expression decides. Rules without such a literal meet every text; there the work is what their result
asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions.globs import glob_regex_col, path_glob_regex_col
from pactline.session import broadcast_checked, cut

_WORD = r"[\p{L}\p{N}_]"
# A word of a rule with the wildcards beside it: no text has less of the word there, and more only on their side.
_PART = rf"(\*?{_WORD}+\*?)"
# Longer starts, ends and insides of words are listed by this many of their characters.
_LONGEST = 32
_ENDS = (8, 4, 2, 1)
_RUN = 3


def _folded(text: Column, ignore_case: bool) -> Column:
    """Letters that the regular expression takes for equal become equal: ASCII only, as there."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if ignore_case else text


def _key(kind: str, text: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), text)


def rule_keys(pattern: Column, over_paths: bool, ignore_case: bool = False) -> Column:
    """Every literal that a rule may be listed under: `w:`, `p<n>:`, `s<n>:`, `i<n>:`, `<n:`, `>n:`, `3:` and the text; `*` without one."""
    text = _folded(pattern, ignore_case)
    core = F.regexp_replace(text, "^/+|/+$", "") if over_paths else text
    # A wildcard between two words opens both of them.
    parts = F.regexp_extract_all(F.regexp_replace(core, r"\*+", "**"), F.lit(_PART), 1)

    def listed(part: Column) -> Column:
        word, before, after = F.replace(part, F.lit("*"), F.lit("")), part.startswith("*"), part.endswith("*")
        n = F.least(F.length(word), F.lit(_LONGEST))
        sized = F.concat(n.cast("string"), F.lit(":"))
        return (
            F.when(before & after, F.concat(F.lit("i"), sized, F.left(word, n)))
            .when(after, F.concat(F.lit("p"), sized, F.left(word, n)))
            .when(before, F.concat(F.lit("s"), sized, F.right(word, n)))
            .otherwise(_key("w", word))
        )

    pieces = F.split(core, r"\*+")
    if over_paths:  # a slash beside a wildcard can stand for nothing
        pieces = F.transform(pieces, lambda p: F.regexp_replace(p, "^/+|/+$", ""))
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    choices = []
    if not over_paths:
        first, last = F.get(pieces, 0), F.element_at(pieces, -1)
        choices += [F.when(F.length(first) >= n, _key(f"<{n}", F.left(first, F.lit(n)))) for n in _ENDS]
        choices += [F.when(F.length(last) >= n, _key(f">{n}", F.right(last, F.lit(n)))) for n in _ENDS]
    choices.append(F.when(F.length(longest) >= _RUN, _key(str(_RUN), F.left(longest, F.lit(_RUN)))))
    found = F.array_distinct(F.concat(F.transform(parts, listed), F.array_compact(F.array(*choices))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("*")))


def rule_key(rules: DataFrame, pattern: str, over_paths: bool, ignore_case: bool = False) -> DataFrame:
    """`pattern, _key`: the literal of a pattern that fewest patterns hold, the longest of several."""
    held = rules.select(pattern).where(F.col(pattern).isNotNull()).distinct()
    held = held.select(pattern, F.explode(rule_keys(F.col(pattern), over_paths, ignore_case)).alias("_key"))
    shared = held.groupBy("_key").agg(F.count("*").alias("_n"))
    rank = F.struct(F.col("_n"), -F.length("_key"), F.col("_key"))
    return held.join(shared, "_key").groupBy(pattern).agg(F.min_by("_key", rank).alias("_key"))


def _text_keys(text: Column, over_paths: bool, lengths: dict[str, list[int]]) -> Column:
    """Everything short of runs that a rule for this text may be listed under; `lengths` by kind of what the rules hold."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_WORD}+)"), 1))
    keys = [F.transform(words, lambda w: _key("w", w)), F.array(F.lit("*"))]

    def of(kind: str, cut_word) -> None:
        for n in lengths.get(kind, []):
            long = F.filter(words, lambda w: F.length(w) >= n)
            keys.append(F.transform(F.array_distinct(cut_word(long, n)), lambda t: _key(f"{kind}{n}", t)))

    of("p", lambda long, n: F.transform(long, lambda w: F.left(w, F.lit(n))))
    of("s", lambda long, n: F.transform(long, lambda w: F.right(w, F.lit(n))))
    of(
        "i",
        lambda long, n: F.flatten(
            F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substr(w, i, F.lit(n))))
        ),
    )
    if not over_paths:
        ends = [F.when(F.length(text) >= n, _key(f"<{n}", F.left(text, F.lit(n)))) for n in _ENDS]
        ends += [F.when(F.length(text) >= n, _key(f">{n}", F.right(text, F.lit(n)))) for n in _ENDS]
        keys.append(F.array_compact(F.array(*ends)))
    return F.concat(*keys)


def _runs(text: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - (_RUN - 1))
    return F.array_distinct(F.transform(F.when(F.length(text) >= _RUN, at), lambda i: _key(str(_RUN), F.substr(text, i, F.lit(_RUN)))))


def join_globs(
    texts: DataFrame, text: str, rules: DataFrame, pattern: str = "pattern", over_paths: bool = False, ignore_case: bool = False
) -> DataFrame:
    """Every row of `texts` with every rule whose pattern matches its column `text`, each pair once.

    Patterns are `globs.glob_regex_col`'s, or with `over_paths` those of `globs.path_glob_regex_col`. The column names of the
    two tables must differ.
    """
    # Rule-sized, and read three times below.
    keyed = cut(rule_key(rules, pattern, over_paths, ignore_case))
    listed = rules.join(keyed, pattern).select(*rules.columns, "_key")
    # At most a few dozen rows: kinds and lengths.
    kinds = keyed.select(F.regexp_extract("_key", "^([pis])([0-9]+):", 1).alias("kind"), F.regexp_extract("_key", "^([pis])([0-9]+):", 2).alias("n"))
    lengths: dict[str, list[int]] = {}
    for row in kinds.where("kind <> ''").distinct().collect():
        lengths.setdefault(row["kind"], []).append(int(row["n"]))
    subject = _folded(F.col(text), ignore_case)
    by_run = F.col("_key").startswith(f"{_RUN}:")
    plain = texts.withColumn("_key", F.explode(_text_keys(subject, over_paths, lengths))).join(broadcast_checked(listed.where(~by_run)), "_key")
    cut_up = texts.withColumn("_key", F.explode(_runs(subject))).join(broadcast_checked(listed.where(by_run)), "_key")
    rx = path_glob_regex_col(F.col(pattern)) if over_paths else glob_regex_col(F.col(pattern), ignore_case)
    return plain.unionByName(cut_up).where(F.rlike(F.col(text), rx)).drop("_key")
