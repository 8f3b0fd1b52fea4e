"""Chat formatting: event-sourced reconstruction, in DataFrame functions only.

The log is a table of events. Events of one message (conversation, message number, copy) are sorted by sequence and
folded: ``message`` sets the text, ``delta`` appends to it, ``edit`` replaces it, ``regenerate`` clears it for the deltas
that follow, ``delete`` removes the message. Every message goes through the fold, one sent whole as a log of one event. The
final messages of a conversation are sorted by number and rendered, each as ``<|im_start|>role\\ntext<|im_end|>\\n``, with
the loss mask as (start, length) code-point spans of assistant texts.

Folding is by message and rendering by conversation, so the rows that meet in a task are those of one conversation's
result, which is one row by definition. Deltas are folded before the shuffle by conversation.

Escapes are reversible: ``<``, any backslashes, ``|`` gains one backslash before the ``|``, so no text holds a control
string; in a role a backslash is ``\\s`` and a newline ``\\n`` besides.

Defined results: null text is empty; a null role is the empty role, and an event's empty role leaves the message's as it
is; a null kind is ``message``; a null seq sorts first; events of one seq are folded by kind (in the order message, edit,
regenerate, delta, delete), then by role and text; an event of an unknown kind changes nothing, and a message that only has
such is none; what comes after a ``delete`` is void, but for a ``message``, which sends it again. A null turn sorts first;
repeated (conversation, turn) rows stay separate turns in the order of role and text; a null conversation id is one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # Every backslash begins an escape, so the two replacements cannot meet.
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


#: Kinds in the order in which events of one seq are folded.
KINDS = ("message", "edit", "regenerate", "delta", "delete")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, seq, kind, role, text, and copy if it is there) -> the final messages (conv_id, message, copy, role, text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    copy = F.col("copy").cast("long") if "copy" in events.columns else F.lit(0).cast("long")
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce(F.col("kind").cast("string"), F.lit("message")))
    event = F.struct(F.col("seq").cast("long").alias("seq"), kind.alias("kind"), text("role").alias("role"), text("text").alias("text"))
    e = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("message").cast("long").alias("message"), copy.alias("copy"), event.alias("event"))
    start = F.struct(F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("live"), F.lit(False).alias("gone"))

    def step(acc: Column, x: Column) -> Column:
        is_ = {name: x["kind"] == k + 1 for k, name in enumerate(KINDS)}
        text = F.when(is_["delta"], F.concat(acc["text"], x["text"])).when(is_["regenerate"] | is_["delete"], F.lit("")).otherwise(x["text"])
        role = F.when(x["role"] != "", x["role"]).otherwise(acc["role"])
        new = F.struct(role.alias("role"), text.alias("text"), (~is_["delete"]).alias("live"), is_["delete"].alias("gone"))
        return F.when(is_["message"] | ((x["kind"] > 0) & ~acc["gone"]), new).otherwise(acc)

    log = F.array_sort(F.collect_list("event"))
    folded = e.groupBy("conv_id", "message", "copy").agg(log.alias("log")).select("conv_id", "message", "copy", F.aggregate("log", start, step).alias("m"))
    return folded.where("m.live").select("conv_id", "message", "copy", F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def render(messages: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, length>>): code points from 0."""
    turn = F.struct(F.col("message"), F.col("role"), F.col("text"), _escape_role(F.col("role")).alias("er"), escape(F.col("text")).alias("et"))
    turns = messages.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = len(OPEN) + 1
    tail = len(CLOSE) + 1
    formatted = F.array_join(F.transform("ts", lambda x: F.concat(F.lit(OPEN), x["er"], F.lit("\n"), x["et"], F.lit(CLOSE + "\n"))), "")
    # Places of texts: a running sum over the lengths of the turns before.
    acc0 = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + head + F.char_length(x["er"])
        n = F.char_length(x["et"]).cast("long")
        span = F.struct(start.alias("start"), n.alias("length"))
        spans = F.when(x["role"] == learned, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((start + n + tail).alias("at"), spans.alias("spans"))

    return turns.select("conv_id", formatted.alias("formatted"), F.aggregate("ts", acc0, place)["spans"].alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Parses formatted conversations: (conv_id, formatted, turns array<struct<role, text>>, learned array<string>)."""
    parts = F.filter(F.split("formatted", r"(?<=<\|im_end\|>)\n(?=<\|im_start\|>|\z)", -1), lambda x: x != "")
    inner = F.transform(parts, lambda x: F.substr(x, F.lit(len(OPEN) + 1), F.char_length(x) - len(OPEN) - len(CLOSE)))
    cut = F.transform(inner, lambda x: F.struct(F.instr(x, F.lit("\n")).alias("at"), x.alias("x")))
    turns = F.transform(cut, lambda c: F.struct(_unescape_role(F.substr(c["x"], F.lit(1), c["at"] - 1)).alias("role"), unescape(F.substr(c["x"], c["at"] + 1, F.char_length(c["x"]))).alias("text")))
    spans = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return rendered.select("conv_id", "formatted", turns.alias("turns"), spans.alias("learned"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log of a chat in which they came about: an assistant's text is streamed as deltas, broken
    off, regenerated and streamed again in three parts; any other is sent as a draft (its first third) and edited. Rows
    that repeat a (conversation, turn) are told apart by a copy number."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.char_length(t)
    third = F.floor((n + 2) / 3).cast("int")
    part = lambda k: F.substr(t, k * third + 1, third)
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(
        event(0, "message", F.lit("")), event(1, "delta", part(0)), event(2, "delta", part(2)), event(3, "regenerate", F.lit("")),
        *(event(4 + k, "delta", part(k)) for k in range(3)),
    )
    drafted = F.array(event(0, "message", part(0)), event(1, "edit", t))
    rows = conversations.select("conv_id", F.col("turn").alias("message"), F.monotonically_increasing_id().alias("copy"), F.col("role").cast("string").alias("role"), "text")
    rows = rows.select("conv_id", "message", "copy", "role", F.explode(F.when(F.col("role") == LEARNED, streamed).otherwise(drafted)).alias("e"))
    return rows.select("conv_id", "message", "copy", F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    return render(fold_events(events_of(conversations)))
