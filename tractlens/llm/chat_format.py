"""Chat formatting by event-sourced reconstruction (native: DataFrame functions only).

A log holds events ``(conversation, seq, message, kind, role, text)``:

- ``delta`` (or null, or any other kind): appends its text to its message;
- ``edit``: replaces the message's text;
- ``regenerate``: restarts its message with its text, and discards what the log
  held until then for the messages after it.

Events are folded to messages per (conversation, message), so that a hot
conversation's log is spread over tasks; only final messages meet per
conversation, where they are rendered::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings inside texts are escaped reversibly: one backslash is put
between ``<`` (with any backslashes after it) and ``|``.  In roles a line feed
becomes ``<|nl|>`` after that.

Edge cases: null text is empty; null roles are empty; a null conversation id is
a conversation of its own; null seq sorts first; events of equal seq are folded
in the order kind, role, text; a message without live events is absent;
a conversation without messages gives no row; texts of any length are kept whole; an empty log gives
an empty table.  Only the event columns are read, so columns with clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The turn template.
TURN_START, TURN_END, ROLE_BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
RESETS = ("edit", "regenerate")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", "<$1|")


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(ROLE_BREAK))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(ROLE_BREAK), F.lit("\n")))


def fold_events(events: DataFrame, conv: str = "conv_id", message: str = "message", seq: str = "seq",
                kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages ``(conv, message, role, text)`` of an event log."""
    ev = events.select(
        F.col(conv).alias("conv"), F.col(message).alias("message"),
        F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(kind), F.lit("delta")).alias("kind"),
                 F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("e"))
    msgs = ev.groupBy("conv", "message").agg(
        F.sort_array(F.collect_list("e")).alias("es"),
        F.max(F.when(F.col("e.kind") == "regenerate", F.col("e.seq"))).alias("regenerated"))
    earlier = Window.partitionBy("conv").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    live = (
        msgs.withColumn("cutoff", F.max("regenerated").over(earlier))
        .withColumn("es", F.when(F.col("cutoff").isNull(), F.col("es"))
                    .otherwise(F.filter("es", lambda e: e["seq"] > F.col("cutoff"))))
        .withColumn("first", F.array_max(F.transform(
            "es", lambda e, i: F.when(e["kind"].isin(*RESETS), i).otherwise(F.lit(0)))))
        .filter(F.size("es") > 0)
        .withColumn("es", F.filter("es", lambda e, i: i >= F.col("first")))
    )
    roles = F.filter(F.transform("es", lambda e: e["role"]), lambda r: r.isNotNull())
    return live.select(
        F.col("conv").alias(conv), F.col("message").alias(message),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform("es", lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, conv: str = "conv_id", message: str = "message",
           loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv, formatted, loss_spans)``; a span is (turn from 0, start and length in that turn's block)."""
    head = F.concat(F.lit(TURN_START), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    m = messages.select(
        F.col(conv).alias("conv"), F.struct(
            F.col(message).alias("message"), F.concat(head, body, F.lit(TURN_END + "\n")).alias("block"),
            F.col("role").isin(*loss_roles).alias("loss"), F.length(head).alias("start"),
            F.length(body).alias("length")).alias("m"))
    g = m.groupBy("conv").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    span = F.transform("ms", lambda x, i: F.struct(
        i.alias("turn"), x["start"].alias("start"), x["length"].alias("length"), x["loss"].alias("loss")))
    return g.select(
        F.col("conv").alias(conv), F.array_join(F.transform("ms", lambda x: x["block"]), "").alias("formatted"),
        F.transform(F.filter(span, lambda s: s["loss"]), lambda s: F.struct(
            s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"))


def format_chats(events: DataFrame, conv: str = "conv_id", message: str = "message", **columns: str) -> DataFrame:
    """Event log to one rendered text and loss mask per conversation."""
    return render(fold_events(events, conv, message, **columns), conv, message)


def _blocks(formatted: Column) -> Column:
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parse(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Inverse of ``render``: ``(conv, turns: array<struct<role, text>>, loss_text: array<string>)``."""
    b = formatted.withColumn("blocks", _blocks(F.col("formatted")))
    header = lambda x: F.substring_index(x, "\n", 1)
    turns = F.transform("blocks", lambda x: F.struct(
        _unescape_role(F.substr(header(x), F.lit(len(TURN_START) + 1))).alias("role"),
        unescape(F.substr(x, F.length(header(x)) + 2)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(
        F.substr(F.element_at("blocks", s["turn"] + 1), s["start"] + 1, s["length"])))
    return b.select(conv, "formatted", turns.alias("turns"), loss.alias("loss_text"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Each row of a conversations table is one streamed message, in the order of turn, role and text."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        "conv_id", F.row_number().over(by_turn).alias("message"), "role", "text", F.lit("delta").alias("kind")
    ).withColumn("seq", F.col("message"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted output."""
    p = parse(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_text", "")
    return p.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
