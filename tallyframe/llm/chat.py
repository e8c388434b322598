"""Chats rebuilt from event logs and rendered as training text, in DataFrame operations.

The template writes a turn as ``<s>role``, a line feed, the text and ``</s>``. A control
string inside a text gets a backslash after its first character, one more if it has some,
so that no text holds a control string and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<s>", "</s>"
# control strings: <s> </s> <unk> [INST] [/INST], each with any number of backslashes inside
ESCAPE = r"([<\[])(\\*)(/?s>|unk>|/?INST\])"
UNESCAPE = r"([<\[])\\(\\*)(/?s>|unk>|/?INST\])"
TURN = "(?s)^<s>([^\n]*)\n(.*)$"
RESETS = ("edit", "regenerate")


def messages(conversations: DataFrame) -> DataFrame:
    """A table of finished messages as a log: every row is an event of its own, by turn."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"),
                                "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log: ``conv_id`` and ``turns``, an array of (turn, seq, role, text).

    Events have ``conv_id``, ``seq`` (their order), ``turn``, ``kind``, ``role``, ``text``. A
    ``message`` is complete in itself, and two at one turn both stay. A ``delta`` adds its
    text to what the turn has. An ``edit`` replaces all of the turn by its text, and a
    ``regenerate`` starts the turn anew, with its text if it has one; deltas that follow
    add to either. Unknown kinds count as messages. Events of one ``seq`` go by kind, role
    and text; rows that repeat count each. Null texts and roles are empty, a null turn
    comes first, and rows without conv_id form one conversation.
    """
    known = events.select("conv_id", "turn", F.struct(
        "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    # one shuffle serves both groupings
    turns = (known.repartition("conv_id").groupBy("conv_id", "turn")
             .agg(F.array_sort(F.collect_list("e")).alias("log")))
    last = F.array_max(F.transform("log", lambda e, n: F.when(e["kind"].isin(*RESETS), n + 1).otherwise(1)))
    turns = turns.withColumn("log", F.slice("log", last, F.size("log")))
    streamed = F.filter("log", lambda e: e["kind"].isin("delta", *RESETS))
    whole = F.filter("log", lambda e: ~e["kind"].isin("delta", *RESETS))
    shaped = lambda seq, role, text: F.struct(
        F.col("turn"), seq.alias("seq"), role.alias("role"), text.alias("text"))
    one = F.array(shaped(streamed[0]["seq"], F.array_max(F.transform(streamed, lambda e: e["role"])),
                         F.array_join(F.transform(streamed, lambda e: e["text"]), "")))
    rest = F.transform(whole, lambda e: shaped(e["seq"], e["role"], e["text"]))
    made = F.when(F.size(streamed) > 0, F.concat(rest, one)).otherwise(rest)
    return turns.select("conv_id", made.alias("made")).groupBy("conv_id").agg(
        F.array_sort(F.flatten(F.collect_list("made"))).alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(folded: DataFrame, trained: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``segments``: the same text in parts, (text, loss).

    Exactly the texts of the ``trained`` role are under the loss mask, not their marks.
    """
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(OPEN), _role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), (t["role"] == trained).alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")))))
    parts = folded.select("conv_id", segments.alias("segments"))
    return parts.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                        "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) in a rendered text."""
    turns = F.split(formatted, CLOSE)
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: F.struct(
        _role_back(F.regexp_extract(t, TURN, 1)).alias("role"), unescape(F.regexp_extract(t, TURN, 2)).alias("text")))


def loss_text(segments: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
