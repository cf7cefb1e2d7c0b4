"""Chat transcripts from event logs: fold events into messages, render them, read them back.

Everything is column functions, aggregates and windows. Events meet first by message, so that a
long conversation's deltas are joined over many tasks; only its finished messages come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLES = ("assistant",)

#: Control strings of this template and of others that a model may know; each is broken inside a text.
LESS, BRACKET = r"<(?=\||/?s>|</?SYS>>)", r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """``text`` without control strings: their first sign, and the backslash, become backslash codes."""
    marked = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.regexp_replace(F.regexp_replace(marked, LESS, r"\\l"), BRACKET, r"\\i")


def unescape(text: Column) -> Column:
    for code, sign in (("\\l", "<"), ("\\i", "["), ("\\b", "\\")):  # the backslash last: it makes no new code
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Rows (conv_id, message, role, text): the final messages of every conversation.

    ``events`` has conv_id, seq, message, kind, role, text. In order of ``seq``: ``delta`` adds its
    text to the message, ``edit`` replaces the message by its text, ``regenerate`` empties it; both
    also drop what the log had of later messages, as the conversation went on from there. Other
    kinds (``open``) add their text like a delta. The role is the last one that is not null, else
    empty. Null texts are empty; equal events are one event, delivered twice; events with equal
    ``seq`` follow in order of kind, role, text. Null ids are ids. Other columns are not read.
    """
    reset = F.col("kind").isin("edit", "regenerate")
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    held = events.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_set(event)).alias("events"), F.max(F.when(reset, F.col("seq"))).alias("reset")
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("cut", F.max("reset").over(earlier))
    alive = F.filter("events", lambda e: F.col("cut").isNull() | (e["seq"] > F.col("cut")))
    held = held.withColumn("events", alive).where(F.size("events") > 0)
    last = F.array_max(F.transform(F.filter("events", lambda e: e["kind"].isin("edit", "regenerate")), lambda e: e["seq"]))
    roles = F.transform(F.filter("events", lambda e: e["role"].isNotNull()), lambda e: e["role"])
    shown = F.filter("events", lambda e: F.col("last").isNull() | (e["seq"] > F.col("last")) | ((e["seq"] == F.col("last")) & (e["kind"] == "edit")))
    return held.withColumn("last", last).select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(shown, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Rows (conv_id, formatted, loss): a text per conversation and the spans to learn from.

    ``loss`` lists (turn, start, stop): the turn's number from 0, and the code points of its escaped
    text in ``formatted``. Null roles and texts are empty. A conversation's text is one value, so one
    task makes it; conversations are spread over all tasks.
    """
    head = F.concat(F.lit(START), escape(F.coalesce("role", F.lit(""))), F.lit(SEP))
    body = escape(F.coalesce("text", F.lit("")))
    rows = messages.select("conv_id", "message", F.coalesce("role", F.lit("")).isin(*loss_roles).alias("learn"), head.alias("head"), body.alias("body"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy("message", "head", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "turn": F.row_number().over(order) - 1,
        "start": F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")) + F.length("head"),
    })
    piece = F.struct("turn", F.concat("head", "body", F.lit(END)).alias("piece"), "learn", "start", (F.col("start") + F.length("body")).alias("stop"))
    pieces = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["learn"]), lambda p: F.struct(p["turn"].alias("turn"), p["start"].alias("start"), p["stop"].alias("stop")))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``: array of (role, text), unescaped, as they were before rendering."""
    parts = F.split("formatted", END.replace("|", r"\|"), -1)
    sides = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, SEP.replace("|", r"\|"), -1))
    turn = lambda s: F.struct(unescape(F.substring(s[0], len(START) + 1, 2**31 - 1)).alias("role"), unescape(s[1]).alias("text"))
    return formatted.withColumn("turns", F.transform(sides, turn))


def log_of(conversations: DataFrame, piece: int = 64) -> DataFrame:
    """An event log that ends in the given turns: drafts, edits, regenerations, streamed deltas.

    Users first send the text in upper case, then edit it. Assistants start an answer, to which a
    further message replies; both go when the answer is regenerated and streamed in pieces. Rows
    are numbered by turn, then role and text; repeated rows are turns of their own.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", number.cast("long"))
    at = lambda k: F.col("message") * (1 << 31) + k
    event = lambda seq, message, kind, role, text: F.struct(
        seq.cast("long").alias("seq"), message.alias("message"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text")
    )
    nobody, own = F.lit(None).cast("string"), F.col("message")
    streamed = F.transform(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda t, k: event(at(k + 4), own, "delta", nobody, t)
    )
    asked = F.array(event(at(0), own, "open", F.col("role"), F.upper("text")), event(at(3), own, "edit", nobody, F.lit("")))
    answered = F.array(
        event(at(0), own, "open", F.col("role"), F.lit("")),
        event(at(1), own, "delta", nobody, F.substring("text", 1, 20)),
        event(at(2), own + 1, "delta", F.lit("user"), F.lit("never sent")),
        event(at(3), own, "regenerate", nobody, nobody),
    )
    events = F.concat(F.when(F.col("role") == "assistant", answered).otherwise(asked), streamed)
    return rows.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")
