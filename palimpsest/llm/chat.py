"""Chat formatting from event logs, in DataFrame functions only.

A log holds events of conversations: ``message`` starts a message, ``delta`` appends to it, ``edit``
replaces its text, ``regenerate`` replaces it and drops all messages that began after it so far. The
fold is relational: texts since a message's last replacement, in order of sequence, and messages that
no earlier message's regeneration has dropped. Then each message is rendered and a conversation's
messages are joined.

The template is ``<turn>role NEWLINE text</turn> NEWLINE``. In roles and texts ``\\`` becomes ``\\s``
and ``<`` becomes ``\\l`` (in roles also a newline ``\\n``), so that no control string can occur inside
them and all come back exactly.

Null texts and roles are empty. Events of one message and sequence number go by kind (delta, edit,
message, regenerate), text, role; messages that begin at the same number by their id. Events of other
kinds or without a kind are left out. A null conversation id is a conversation of its own. A
conversation ends up in one cell: that is the output asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "delta", "edit", "regenerate")
OPEN, CLOSE = "<turn>", "</turn>\n"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _replace(_replace(text, "\\", "\\s"), "<", "\\l")


def unescape(text: Column) -> Column:
    return _replace(_replace(text, "\\l", "<"), "\\s", "\\")


def messages_from_rows(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Events for logs that hold whole messages: one ``message`` per row, by turn, then role and text."""
    order = Window.partitionBy(conv_col).orderBy(turn_col, F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    number = F.row_number().over(order).cast("long")
    return rows.select(F.col(conv_col).alias("conv_id"), number.alias("seq"), F.lit("message").alias("kind"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).select(
        "conv_id", "seq", F.col("seq").alias("message_id"), "kind", "role", "text"
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, place, role, text)`` of ``(conv_id, seq, message_id, kind, role, text)``."""
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    event_role = F.coalesce("role", F.lit(""))
    known = events.where(F.col("kind").isin(*KINDS))
    one = known.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("began"),
        F.min_by(event_role, F.struct(event, event_role)).alias("role"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.sort_array(F.collect_list(event)).alias("log"),
    )
    # a replacement's place in the log; a message without one is the sum of its deltas
    since = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(0))))
    text = F.array_join(F.transform(F.slice("log", since + 1, F.size("log")), lambda e: e["text"]), "")
    order = Window.partitionBy("conv_id").orderBy("began", "message_id")
    earlier = F.max("again").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = one.select("conv_id", "began", "message_id", "role", text.alias("text"), earlier.alias("_again"))
    kept = kept.where(F.col("_again").isNull() | (F.col("_again") <= F.col("began")))
    return kept.select("conv_id", F.row_number().over(order).alias("place"), "role", "text")


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss)``; ``loss`` lists the code points of ``trained`` texts, as ``begin``
    and ``length`` in the formatted text."""
    head = F.concat(F.lit(OPEN), _replace(escape(F.col("role")), "\n", "\\n"), F.lit("\n"))
    parts = messages.select("conv_id", "place", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == trained, F.struct(begin.alias("begin"), F.length("body").cast("long").alias("length")))
    parts = parts.select("conv_id", F.struct("place", "piece", span.alias("span")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("parts")["piece"], "").alias("formatted"),
        F.filter(F.col("parts")["span"], lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text``, both read from the formatted text alone."""
    turns = F.split("formatted", CLOSE)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        role = F.substring_index(inner, "\n", 1)
        text = F.substring(inner, F.length(role) + 2, F.length(inner))
        return F.struct(unescape(_replace(role, "\\n", "\n")).alias("role"), unescape(text).alias("text"))

    masked = F.transform("loss", lambda s: F.substring(F.col("formatted"), s["begin"].cast("int") + 1, s["length"].cast("int")))
    return formatted.withColumns(
        {"turns": F.transform(F.slice(turns, 1, F.size(turns) - 1), turn), "loss_text": unescape(F.array_join(masked, ""))}
    )
