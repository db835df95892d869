"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log of events (conversation, sequence number, turn, kind, role, text) is partitioned by
conversation and sorted by sequence. Kinds:

* ``message`` starts the message of its turn, or starts it again;
* ``delta`` appends its text to the message;
* ``edit`` replaces the text; the role stays unless the event names one;
* ``regenerate`` empties its turn (a text replaces it) and takes away all later turns, which
  answered the old text.

So an event counts unless a later one replaces it: a message, edit or regeneration of the
same turn, or a regeneration of an earlier turn. What counts of a turn is joined by sequence;
the turns of a conversation are then rendered.

The template marks a turn as ``<|role|>\\n`` text ``</s>\\n``. Control strings inside texts and
roles get a backslash after their first character, and a backslash is doubled, so no control
string of a text stands in the output and unescaping gives back the text. The loss mask
covers assistant texts.

Defined results: null texts and roles are empty; events of unknown kind raise an error; equal
sequence numbers go by kind, role and text; an event without conversation belongs to the
conversation null; repeated events count each; an empty log gives no rows. A very long text is
escaped and sliced whole. Only the columns of the log are read; any others drop out, so no names
clash. A conversation is one row of the result, so all its text meets in one task; conversations
themselves are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The strings that steer a chat format, of this template and of common others.
CONTROL = ["<s>", "</s>", "<|", "|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
ORDER = ["seq", "kind", "role", "text"]


def escape(text: Column) -> Column:
    """Put a backslash after the first character of each control string; double backslashes."""
    found = "|".join(rf"\{c[0]}(?=\Q{c[1:]}\E)" for c in CONTROL)
    return F.regexp_replace(text, rf"({found}|\\)", r"$1\\")


def unescape(text: Column) -> Column:
    """Undo :func:`escape`."""
    return F.regexp_replace(text, r"([<\[|\\])\\", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of the log (conv_id, seq, turn, kind, role, text)."""
    known = F.col("kind").isin("message", "delta", "edit", "regenerate")
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))))
    log = events.select("conv_id", "seq", "turn", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    newest = [F.desc(c) for c in ORDER]
    later = Window.partitionBy("conv_id").orderBy(*newest).rowsBetween(Window.unboundedPreceding, -1)
    later_of_turn = Window.partitionBy("conv_id", "turn").orderBy(*newest).rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumns(
        {
            "__cut": F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later),
            "__live": F.count(F.when(F.col("kind") != "delta", F.lit(1))).over(later_of_turn) == 0,
        }
    )
    event = F.struct(*ORDER)
    named = F.max_by("role", F.when(F.col("role") != "", event))  # an edit or regeneration need not repeat the role
    parts = F.sort_array(F.collect_list(F.when(F.col("__live"), event)))
    return (
        log.where(F.col("__cut").isNull() | (F.col("__cut") >= F.col("turn")))
        .groupBy("conv_id", "turn")
        .agg(F.coalesce(named, F.lit("")).alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) of the messages (conv_id, turn, role, text), turns in order.

    ``loss`` lists start and end, in code points of ``formatted``, of the texts of the role ``learn``.
    """
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    pieces = messages.select("conv_id", "turn", "role", head.alias("__head"), escape(F.col("text")).alias("__body"))
    piece = F.concat("__head", "__body", F.lit("</s>\n"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(piece)).over(before), F.lit(0)) + F.length("__head")
    pieces = pieces.withColumns({"__piece": piece, "__start": start}).withColumn("__end", F.col("__start") + F.length("__body"))
    turns = F.sort_array(F.collect_list(F.struct("turn", F.col("__piece").alias("piece"))))
    spans = F.sort_array(F.collect_list(F.when(F.col("role") == learn, F.struct(F.col("__start").alias("start"), F.col("__end").alias("end")))))
    grouped = pieces.groupBy("conv_id").agg(turns.alias("turns"), spans.alias("loss"))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), "loss")


def parse(formatted: Column) -> Column:
    """Array of (role, text) that :func:`render` wrote."""
    turns = F.filter(F.split(formatted, "</s>\n"), lambda p: p != "")
    at = lambda p: F.locate("|>\n", p)
    return F.transform(turns, lambda p: F.struct(unescape(F.substring(p, F.lit(3), at(p) - 3)).alias("role"), unescape(F.substring(p, at(p) + 3, F.length(p))).alias("text")))


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
