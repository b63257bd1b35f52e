r"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: a message is opened, grows by streamed deltas, is edited (its text replaced) or
regenerated (its text dropped and streamed anew), or is deleted.  The log is partitioned by conversation, sorted by
sequence number and folded into final messages, which are rendered with a template.  An ordered gathering of each message's
events, and of the already escaped turns, does the work; the only thing that is put together in
one place is a conversation's own text, which the output holds in one row.

The template writes a turn as ``<|turn|>role\ntext<|end|>\n``.  In roles and texts a backslash becomes ``\0``, ``<|``
becomes ``\1`` and, in roles, a line feed becomes ``\2``; so control strings can't occur inside a text, and reading back
is exact.  The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

TURN, END = "<|turn|>", "<|end|>\n"
EVENTS = "conv_id, seq, message, op, role, text"


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("\\1"))
    return F.replace(out, F.lit("\n"), F.lit("\\2")) if role else out


def unescape(c: Column) -> Column:
    """Every backslash of an escaped text has its digit behind it, so the order of replacing is safe."""
    return F.replace(F.replace(F.replace(c, F.lit("\\2"), F.lit("\n")), F.lit("\\1"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log with columns conv_id, seq, message, op, role, text.

    Operations: "open" (role, first text), "regenerate" (the text starts anew), "edit" (new text), "delete" and "delta" (more text).
    Events of a message apply one after the other by sequence number (null first), those of one number in the order
    in which the operations stand here, then by text; a replacing event (all but deltas) drops what came before it, so that of two edits with
    one number the later text stands.  Events that repeat number, operation and text were delivered again and
    apply once.  Returns conv_id, message, at (sequence number of its first event), role (of the first event with one) and text.  Unknown operations count as deltas; null texts are empty; a
    message whose last replacing event is "delete" is left out, whatever was streamed after it.  Null conversations and messages are keys of their own.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[x for i, op in enumerate(("open", "regenerate", "edit", "delete")) for x in (F.lit(op), F.lit(i))]), F.coalesce("op", F.lit(""))), F.lit(4))
    e = F.struct(F.col("seq").cast("long").alias("seq"), rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.min(F.when(F.col("role").isNotNull(), F.struct(F.col("e.seq").alias("s"), F.col("e.rank").alias("k"), "role")))["role"]
    logs = events.select("conv_id", "message", e.alias("e"), "role").groupBy("conv_id", "message").agg(F.min("e.seq").alias("at"), first.alias("role"), F.sort_array(F.collect_list("e")).alias("log"))
    once = F.filter("log", lambda e, i: (i == 0) | ~e.eqNullSafe(F.get("log", i - 1)))
    logs = logs.select("conv_id", "message", "at", "role", once.alias("log"))
    # the place of the last event that replaces the text
    start = F.array_max(F.transform("log", lambda e, i: F.when(e["rank"] < 4, i)))
    logs = logs.select("conv_id", "message", "at", "role", "log", start.alias("start"))
    live = F.slice("log", F.coalesce("start", F.lit(0)) + 1, F.size("log"))
    gone = F.coalesce(F.get("log", F.col("start"))["rank"] == 3, F.lit(False))
    return logs.filter(~gone).select("conv_id", "message", "at", "role", F.concat_ws("", F.transform(live, lambda e: e["text"])).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, and loss_mask, an array of (start, end) in code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = W.partitionBy("conv_id").orderBy("at", "role", "text", "message")
    shown = messages.select("conv_id", "at", "message", role.alias("role"), text.alias("text"))
    shown = shown.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role"), True), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    size = F.length("head") + F.length("body") + F.lit(len(END))
    before = F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = before + F.length("head")
    turn = F.struct(F.row_number().over(order).alias("i"), F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end"))).alias("loss"))
    turns = shown.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return turns.select(
        "conv_id",
        F.concat_ws("", F.transform("turns", lambda t: t["turn"])).alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda m: m.isNotNull()).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    head = F.lit(len(TURN) + 1)

    def turn(p: Column) -> Column:
        line = F.instr(p, "\n")
        return F.struct(unescape(F.substring(p, head, line - head)).alias("role"), unescape(F.substring(p, line + 1, F.length(p))).alias("text"))

    return F.transform(turns, turn)


def events_of(rows: DataFrame) -> DataFrame:
    """An event log (``EVENTS``) that ends in the turns (conv_id, turn, role, text), as a chat service would have written it.

    A user's message is typed in two deltas; one in three is sent with its second half alone and then edited.  An assistant's
    message is streamed in three deltas; of each three the second was begun wrong and regenerated, and the third was streamed
    in another order than numbered.  Events come in no particular order; a delivery is repeated here and there.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    numbered = rows.select("conv_id", "role", text.alias("text"), (F.row_number().over(order).cast("long") - 1).alias("message"))
    n = F.length("text")
    third = F.greatest(F.lit(1), F.floor(n / 3).cast("int"))
    one, two, three = F.substr("text", F.lit(1), third), F.substr("text", third + 1, third), F.substr("text", 2 * third + 1, n)

    def event(i: int, op: str, text: Column, role: Column | None = None) -> Column:
        return F.struct((F.col("message") * 8 + i).alias("seq"), F.lit(op).alias("op"), (role if role is not None else F.lit(None).cast("string")).alias("role"), text.alias("text"))

    opened = lambda text: event(0, "open", text, F.col("role"))
    typed = F.array(opened(F.lit("")), event(1, "delta", F.concat(one, two)), event(2, "delta", three))
    edited = F.array(opened(three), event(1, "edit", F.col("text")), event(1, "edit", F.col("text")))
    streamed = F.array(opened(F.lit("")), event(1, "delta", one), event(2, "delta", two), event(3, "delta", three))
    anew = F.array(opened(F.lit("")), event(1, "delta", three), event(2, "regenerate", F.lit("")), event(3, "delta", one), event(4, "delta", two), event(5, "delta", three))
    mixed = F.array(event(3, "delta", three), event(1, "delta", one), event(2, "delta", two), event(2, "delta", two), opened(F.lit("")))
    kind, said = F.col("message") % 3, F.coalesce(F.col("role") == "assistant", F.lit(False))
    log = F.when(said & (kind == 1), anew).when(said & (kind == 2), mixed).when(said, streamed).when(kind == 2, edited).otherwise(typed)
    return numbered.select("conv_id", "message", F.explode(log).alias("e")).select("conv_id", "e.seq", "message", "e.op", "e.role", "e.text")


def format_conversations(rows: DataFrame) -> DataFrame:
    """Formatted conversations of a table of turns (conv_id, turn, role, text): see :func:`render`.

    Every row is a message of its own, whose event log (:func:`events_of`) is folded; rows are ordered by turn (null first), then role, then text,
    rows that repeat are turns of their own.  Other columns are ignored; an empty table gives an empty result.
    """
    return render(fold(events_of(rows)))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_conversations(rows).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), "loss_mask")
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    masked = F.concat_ws("", F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"].cast("int") + 1, (m["end"] - m["start"]).cast("int")))))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = "replace(replace({0}, '\\', '\\0'), '<|', '\\1')"
_TRICKY = "'\\### Assistant: </turn> ok'"
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_TRICKY} UNION ALL SELECT -7, 1, 'assistant', {_TRICKY}),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(TURN)} + length(replace({_ESC.format("role")}, chr(10), '\\2')) + 1 + length({_ESC.format("text")}) + {len(END)}) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
