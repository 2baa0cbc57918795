"""Chat formatting from event logs.

A log holds one row per event: conversation, sequence number, message number, kind, role and
payload.  Kinds: ``start`` (names the message's role), ``delta`` (appends text), ``edit`` (replaces
the text so far) and ``regenerate`` (drops the text so far).  Events of a message are sorted by
sequence and folded; messages are rendered one by one and only the rendered turns of a
conversation meet, sorted, in one row (a conversation's output is one cell, so it must fit).

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn.  Inside roles and texts a
backslash is doubled and every control string gets a backslash after its first character, so
that none can be forged and all come back on reading.  The loss mask lists spans (start, length in
code points) of the assistant texts.

Defined cases: null payload, text or role: empty; null message or sequence numbers sort first, ties
by kind, role and payload; a null conversation is a group of its own; repeated rows of a table
count as turns of their own; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEGIN, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: first character, then the rest of control strings of common chat templates
CONTROL = (r"<(\||/?s>|</?SYS>>)", r"\[(/?INST\])")


def escape(text: F.Column) -> F.Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(out, CONTROL[0], r"<\\$1"), CONTROL[1], r"[\\$1")


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_from_rows(rows: DataFrame, chunk: int = 64) -> DataFrame:
    """The event log that a chat server would have kept for ``rows`` (conv_id, turn, role, text).

    Every message starts and streams its text in deltas; an assistant's message was generated
    once before and dropped, and a user's first draft was edited."""
    text = F.coalesce("text", F.lit(""))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), text)
    m = rows.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.row_number().over(w).cast("long").alias("message"))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(length(text) - 1) div {chunk}"))), lambda i: F.substring("text", i * chunk + 1, F.lit(chunk)))
    event = lambda kind, payload: F.struct(F.lit(kind).alias("kind"), payload.cast("string").alias("payload"))
    draft = F.when(F.col("role") == "assistant", F.array(event("delta", F.lit("draft ")), event("regenerate", F.lit(None)))).otherwise(F.array(event("delta", F.lit("draft")), event("edit", F.lit(""))))
    start = F.array(event("start", F.lit(None)))
    deltas = F.transform(parts, lambda p: event("delta", p))
    ev = m.select("conv_id", "message", "role", F.posexplode(F.concat(start, draft, deltas)).alias("i", "e"))
    return ev.select("conv_id", "message", (F.col("message") * F.lit(1 << 24) + F.col("i")).alias("seq"), F.col("e.kind").alias("kind"), F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), F.col("e.payload").alias("payload"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: events folded per message.

    Everything after the last edit or regeneration counts, the edit's own text included."""
    row = F.struct("seq", "kind", "role", "payload")
    got = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(row)).alias("ev"))
    reset = F.array_max(F.transform("ev", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(F.lit(-1))))
    alive = F.filter("ev", lambda e, i: ((e["kind"] == "delta") & (i > F.col("reset"))) | ((e["kind"] == "edit") & (i == F.col("reset"))))
    roles = F.filter("ev", lambda e: (e["kind"] == "start") & e["role"].isNotNull())
    got = got.withColumn("reset", reset)
    return got.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1))["role"], F.lit("")).alias("role"), F.array_join(F.transform(alive, lambda e: F.coalesce(e["payload"], F.lit(""))), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (array of start and length of each assistant text)."""
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(SEP))
    body = escape(F.col("text"))
    each = messages.select("conv_id", "message", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss"))
    turn = F.struct("message", F.concat("head", "body", F.lit(END)).alias("out"), F.length("head").alias("skip"), F.length("body").alias("n"), "loss")
    conv = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # running offset of each turn, then the spans of assistant texts
    at = F.aggregate(
        "t", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans")),
        lambda a, x: F.struct((a["at"] + F.length(x["out"])).alias("at"), F.when(x["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + x["skip"]).alias("start"), x["n"].alias("length"))))).otherwise(a["spans"]).alias("spans")),
    )
    return conv.select("conv_id", F.array_join(F.col("t.out"), "").alias("formatted"), at["spans"].alias("loss"))


def format_chat(events: DataFrame) -> DataFrame:
    return render(fold(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role, text) and loss_text, read from the output alone."""
    raw = F.filter(F.split("formatted", r"<\|im_end\|>"), lambda x: x != "")
    turns = F.transform(raw, lambda x: F.struct(unescape(F.substring_index(F.substring(x, F.lit(len(BEGIN) + 1), F.length(x)), SEP, 1)).alias("role"), unescape(F.substring(x, F.instr(x, SEP) + F.lit(len(SEP)), F.length(x))).alias("text")))
    spans = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), spans.alias("loss_text"))
