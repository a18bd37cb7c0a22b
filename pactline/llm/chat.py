"""Chat formatting from event logs, in DataFrame functions only (operator 3).

A log holds events of conversations: `delta` appends to a message, `edit` replaces what the message holds, `regenerate`
drops it and starts again, `delete` takes the message back. `final_messages` partitions the log by conversation and message,
puts it in order of its sequence numbers and folds it to the final texts: what counts is the last event that resets the
message and the deltas after it. `render` writes the turns of each conversation in their order between control marks, with
control strings inside texts escaped, and gives the spans under the loss mask; `turns_of` and `loss_text` read both back.

Marks: `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. In texts and roles `~` becomes `~0` and `<|`
becomes `~1`, in roles a line feed becomes `~2`, so no text can hold a mark, and every text comes back as it was.

Defined results: null roles and texts are empty; rows of null conversation id are one conversation; equal sequence numbers
are ordered by kind and text, equal rows stay; a conversation without a message left is absent; a table without rows gives
none; only the named columns are read. A conversation becomes one row, so it must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
KINDS = ("delta", "edit", "regenerate", "delete")


def _swap(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    """A text without control strings."""
    return _swap(_swap(text, "~", "~0"), "<|", "~1")


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    return _swap(_swap(text, "~1", "<|"), "~0", "~")


def escape_role(role: Column) -> Column:
    return _swap(escape(role), "\n", "~2")


def unescape_role(role: Column) -> Column:
    return unescape(_swap(role, "~2", "\n"))


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Finished turns (`conv_id, turn, role, text`) as a log: one delta a turn, in order of the turns."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    seq = F.row_number().over(order).cast("long")
    return turns.select("conv_id", seq.alias("seq"), seq.alias("message"), F.lit("delta").alias("kind"), "role", "text")


def final_messages(log: DataFrame) -> DataFrame:
    """`conv_id, at, role, text`: the messages that a log (`conv_id, message, seq, kind, role, text`) leaves."""
    event = F.struct(
        "seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")
    )
    folded = log.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("events"))
    resets = F.filter("events", lambda e: e["kind"] != "delta")
    last = F.element_at(F.concat(F.array(F.struct(
        F.lit(None).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.lit("").alias("text"), F.lit("").alias("role")
    )), resets), -1)
    folded = folded.withColumn("last", last)
    after = F.filter("events", lambda e: (e["kind"] == "delta") & (F.col("last.seq").isNull() | (e["seq"] > F.col("last.seq"))))
    text = F.concat(
        F.when(F.col("last.kind") == "edit", F.col("last.text")).otherwise(F.lit("")),
        F.array_join(F.transform(after, lambda e: e["text"]), ""),
    )
    first = F.element_at("events", 1)
    return folded.where("last.kind <> 'delete'").select("conv_id", first["seq"].alias("at"), first["role"].alias("role"), text.alias("text"))


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """`conv_id, formatted, loss_spans`: each conversation's turns between marks, and where the loss applies.

    A span has the code point it starts at (from 0) and its length.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "at", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + F.lit(len(END))
    order = W.partitionBy("conv_id").orderBy("at", "role", "body")
    parts = parts.withColumn("n", F.row_number().over(order))
    before = F.sum(size.cast("long")).over(W.partitionBy("conv_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)) - size
    span = F.when(F.col("role") == learn_role, F.struct((before + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length")))
    parts = parts.select("conv_id", "n", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    turn = F.struct("n", "piece", "span")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def turns_of(formatted: Column) -> Column:
    """Array of `role, text` read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p.startswith(START))

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(body, F.char_length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    texts = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(texts, "")
