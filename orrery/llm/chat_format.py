"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``message`` (a whole text), ``delta`` (a piece streamed to a
message), ``edit`` (a new text for it) and ``regenerate`` (its text is void, new deltas follow).  The log
is partitioned by conversation and message, sorted by sequence and folded into the final texts; these
are gathered by conversation, in order of their first events, and rendered.

Template: a turn is ``### Role: text</turn>`` and a line end.  Inside texts and roles the control strings
are escaped reversibly: a backslash is ``\\b``, ``### `` is ``\\h`` and ``</turn>`` is ``\\t``; in roles a colon is ``\\c``.
So an unescaped control string is always a mark, and every backslash starts a two-letter code.

Defined results: null texts and roles are empty.  Events of equal conversation, message and sequence
are taken in the order of kind, role and text; rows without a message id are messages of their own, so
repeated rows are repeated turns.  A null conversation id is a conversation like others.  Deltas before
any message count from the empty text.  A conversation is one row of output by nature; its size is
that conversation's text.  Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, END = "### ", "</turn>\n"
KINDS = ("message", "edit", "regenerate", "delta")


def escape(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in [("\\", "\\b"), ("### ", "\\h"), ("</turn>", "\\t")] + [(":", "\\c")] * role:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape(text: Column) -> Column:
    out = text
    for a, b in [("\\c", ":"), ("\\t", "</turn>"), ("\\h", "### "), ("\\b", "\\")]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: Where messages without a turn go: before all others of their conversation.
FIRST, STEPS = -(1 << 40), 8


def as_events(messages: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text", streamed: str = "assistant") -> DataFrame:
    """A table of whole messages as the log that would have led to them.

    A message of the role ``streamed`` comes in pieces, is given up, and comes again; any other is sent half
    written and then edited.  Each row is a message of its own: its number only tells it from the others.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    half = F.expr("char_length(t) div 2")
    event = lambda step, kind, part: F.struct((F.col("at") + step).alias("seq"), F.lit(kind).alias("kind"), part.alias("text"))
    head, tail = F.substring("t", F.lit(1), half), F.substring("t", half + 1, F.char_length("t"))
    rows = messages.select(F.col(conv).alias("conv_id"), (F.coalesce(F.col(seq).cast("bigint"), F.lit(FIRST)) * STEPS).alias("at"), F.monotonically_increasing_id().cast("string").alias("msg_id"), F.col(role).alias("role"), whole.alias("t"))
    spoken = F.array(event(0, "message", F.lit("")), event(1, "delta", head), event(2, "regenerate", F.lit("")), event(3, "delta", head), event(4, "delta", tail))
    typed = F.array(event(0, "message", head), event(1, "edit", F.col("t")))
    return rows.select("conv_id", "msg_id", "role", F.explode(F.when(F.col("role") == streamed, spoken).otherwise(typed)).alias("e")).select("conv_id", "e.seq", "e.kind", "msg_id", "role", "e.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turns): turns is the array<struct<seq, role, text>> of final messages.

    events: conv_id, seq, kind, msg_id (null: a message of its own), role, text.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    rows = events.filter(F.col("kind").isin(*KINDS)).select("conv_id", "msg_id", F.when(F.col("msg_id").isNull(), F.col("seq")).alias("_own"), F.struct("seq", order.alias("k"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    logs = rows.groupBy("conv_id", "msg_id", "_own").agg(F.array_sort(F.collect_list("e")).alias("log"))
    # Only what follows the last event that sets the text matters: the text is one join of pieces.
    last = F.aggregate("log", F.struct(F.lit(0).alias("i"), F.lit(1).alias("at")), lambda a, e: F.struct((a["i"] + 1).alias("i"), F.when(e["k"].isin(1, 2, 3), a["i"] + 1).otherwise(a["at"]).alias("at")))["at"]
    tail = F.slice("log", F.col("at"), F.size("log"))
    # The turn's role is the first that is given.
    role = F.coalesce(F.get(F.filter("log", lambda e: e["role"] != ""), 0)["role"], F.lit(""))
    text = F.array_join(F.transform("tail", lambda e: F.when(e["k"] == 3, F.lit("")).otherwise(e["text"])), "")
    folded = F.array(F.struct(F.get("log", 0)["seq"].alias("seq"), role.alias("role"), text.alias("text")))
    own = F.transform("log", lambda e: F.struct(e["seq"].alias("seq"), e["role"].alias("role"), e["text"].alias("text")))
    done = logs.withColumn("at", F.when(F.col("msg_id").isNotNull(), last).otherwise(F.lit(1))).withColumn("tail", tail)
    done = done.select("conv_id", F.when(F.col("msg_id").isNull(), own).otherwise(folded).alias("m"))
    return done.groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("turns"))


def render(convs: DataFrame, *, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask): loss_mask is the array<struct<start, end>> of code points to learn.

    A conversation's mask holds one span for each turn of the role to learn, in order.
    """
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(": "))
    parts = convs.select("conv_id", F.transform("turns", lambda t: F.struct(head(t).alias("h"), escape(t["text"]).alias("t"), (t["role"] == learn).alias("l"))).alias("p"))
    sizes = F.transform("p", lambda x: F.struct(F.char_length(x["h"]).alias("h"), F.char_length(x["t"]).alias("t"), x["l"].alias("l")))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["h"] + x["t"] + len(END)).alias("at"), F.when(x["l"], F.array_append(a["out"], F.struct((a["at"] + x["h"]).alias("start"), (a["at"] + x["h"] + x["t"]).alias("end")))).otherwise(a["out"]).alias("out"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["h"], x["t"], F.lit(END))), "")
    return parts.select("conv_id", text.alias("formatted"), F.aggregate(sizes, zero, step)["out"].alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text, head>>: the turns read back; head is the length of a turn's mark."""
    # No unescaped end mark occurs inside a text, so a split by the end mark gives the turns.
    pieces = F.filter(F.split(formatted, r"</turn>\n"), lambda p: p != "")
    at = lambda p: F.locate(": ", p)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), at(p) - (len(OPEN) + 1))).alias("role"), F.substring(p, at(p) + 2, F.char_length(p)).alias("raw"), (at(p) + 1).alias("head"), F.char_length(p).alias("n")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the mask, spans joined with nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(rendered: DataFrame) -> DataFrame:
    """What is read back from the output of render."""
    turns = F.transform("_p", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["raw"]), F.lit("\n")))
    out = rendered.withColumns({"_p": parse(F.col("formatted")), "_l": under_mask(F.col("formatted"), F.col("loss_mask"))})
    return out.select("conv_id", F.size("_p").cast("bigint").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.char_length("_l").cast("bigint").alias("loss_chars"), F.sha2("_l", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))


PLANTED = r"\### Assistant: </turn> ok"


def oracle() -> str:
    esc = lambda c, role=False: "replace(" * (3 + role) + f"coalesce({c}, '')" + ", '\\', '\\b'), '### ', '\\h'), '</turn>', '\\t')" + ", ':', '\\c')" * role
    return (
        f"WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}') "
        "SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, "
        "CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, "
        "sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, "
        f"CAST(sum(length({esc('role', True)}) + length({esc('text')}) + {len(OPEN) + 2 + len(END)}) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id"
    )
