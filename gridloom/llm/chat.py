"""Operator 11: chat formatting by event-sourced reconstruction [native].

A log holds events of messages of conversations. In the order of their sequence they are folded into final messages:

* ``message`` opens a message with a whole text, ``edit`` gives it another text;
* ``delta`` adds a streamed piece to its end;
* ``regenerate`` empties it for a new stream and drops the messages opened after it and before this event;
* ``delete`` drops it; deltas that come later are lost, any other event brings it back.

Messages stand in the order in which they were opened; a message takes the first role that one of its events gives.

The fold is associative: a stretch of events is its last reset, if any, and the text since. So it is done by stretches of
``STRETCH`` sequence numbers of a message first, whose results are folded by message, and messages are rendered by
stretches of a conversation before the whole is joined: a task never gathers a conversation's events, only what is left of
them. What a regeneration drops is found by running maxima, within stretches and over stretches.

The template is ``<turn ROLE>``, a line break, the text, ``</turn>``, a line break. In texts every ``<turn`` and ``</turn``,
however many backslashes stand after its ``<``, gets one more of them there, which is taken away on reading. In roles ``%``,
``<`` and ``>`` are percent-encoded. The loss mask is a list of spans in code points of the formatted text, one for each
message of a role that is trained on, from the first character of its text to the last.

Null texts and roles are empty. Events without a message are messages of their own, one for each sequence number. Events
without a conversation are one conversation, with a null id; null sequence numbers come first. Unknown and null kinds are
left out. Events of equal sequence come in the order message, edit, regenerate, delete, delta, then by text and role;
messages opened at equal sequence in the order of their ids. Repeated events apply each time, which only deltas show.
A conversation without messages has no row. Empty logs give no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers folded or rendered at once.
STRETCH = 256
#: Kinds of events, in the order in which those of equal sequence apply.
KINDS = ["message", "edit", "regenerate", "delete", "delta"]
OPEN, CLOSE = "<turn ", "</turn>\n"
#: In this order for writing; for reading in the reverse order.
ROLE_CODES = [("%", "%25"), ("<", "%3C"), (">", "%3E")]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*/?turn)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*/?turn)", r"<$1")


def escape_role(role: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ROLE_CODES, role)


def unescape_role(role: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(ROLE_CODES), role)


def since_reset(parts: Column, reset: Column) -> Column:
    """Of an array of (reset, dead, text, ...) in order: what stands from its last reset on."""
    return F.when(reset == 0, parts).otherwise(F.slice(parts, F.greatest(reset, F.lit(1)), F.size(parts)))


def folded(parts: str) -> list[Column]:
    """(reset, dead, text) of an array of such parts in order."""
    last = F.coalesce(F.array_max(F.transform(F.col(parts), lambda x, i: F.when(x["reset"], i + 1))), F.lit(0))
    left = since_reset(F.col(parts), last)
    # A deleted message takes no deltas.
    dead = F.exists(left, lambda x: x["dead"])
    text = F.when(dead, "").otherwise(F.array_join(F.transform(left, lambda x: x["text"]), ""))
    return [(last > 0).alias("reset"), dead.alias("dead"), text.alias("text")]


def final_messages(events: DataFrame, conversation: str = "conv_id", message: str = "message_id", sequence: tuple[str, ...] = ("seq",), kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, opened, id, role, text): the messages that are left, ``opened`` being the columns of ``sequence`` as a struct."""
    c = lambda name: F.col(f"`{name}`")
    names = [f"s{i}" for i in range(len(sequence))]
    seq = F.struct(*(c(s).cast("bigint").alias(n) for s, n in zip(sequence, names, strict=True)))
    coarse = F.struct(*(c(s).cast("bigint").alias(n) for s, n in zip(sequence[:-1], names, strict=False)), F.floor(c(sequence[-1]) / STRETCH).alias(names[-1]))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), c(kind)).cast("int")
    rows = events.filter(c(kind).isin(KINDS)).select(
        c(conversation).alias("conv"),
        # Without an id the sequence itself names the message.
        F.struct(c(message).alias("id"), F.when(c(message).isNull(), seq).alias("own")).alias("id"),
        coarse.alias("stretch"),
        F.struct(
            seq.alias("seq"),
            rank.alias("rank"),
            F.when(c(kind) == "delete", "").otherwise(F.coalesce(c(text), F.lit(""))).alias("text"),
            c(role).alias("role"),
            (c(kind) != "delta").alias("reset"),
            (c(kind) == "delete").alias("dead"),
        ).alias("event"),
        F.when(c(role).isNotNull(), F.struct(seq.alias("seq"), rank.alias("rank"), c(role).alias("role"))).alias("named"),
        seq.alias("seq"),
        F.when(c(kind) == "regenerate", seq).alias("again"),
    )
    facts = [F.min("seq").alias("seq"), F.max("again").alias("again"), F.min("named").alias("named")]
    stretches = rows.groupBy("conv", "id", "stretch").agg(F.array_sort(F.collect_list("event")).alias("parts"), *facts)
    part = stretches.select("conv", "id", "seq", "again", "named", F.struct("stretch", *folded("parts")).alias("part"))
    messages = part.groupBy("conv", "id").agg(F.array_sort(F.collect_list("part")).alias("parts"), *facts)
    made = messages.select("conv", "id", "seq", "again", F.col("named.role").alias("role"), *folded("parts"), F.floor(F.col("seq.s0") / STRETCH).alias("stretch"))
    return dropped(made).select("conv", F.col("seq").alias("opened"), "id", F.coalesce("role", F.lit("")).alias("role"), "text", "stretch")


def dropped(made: DataFrame) -> DataFrame:
    """Messages but those that are dead or lie between the opening and the last regeneration of one opened before them."""
    inside = Window.partitionBy("conv", "stretch").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    points = made.groupBy("conv", "stretch").agg(F.max("again").alias("again"))
    earlier = points.select(F.col("conv").alias("conv2"), F.col("stretch").alias("stretch2"), F.max("again").over(before).alias("earlier")).filter(F.col("earlier").isNotNull())
    here = made.withColumn("until", F.max("again").over(inside))
    both = here.join(earlier, F.col("conv").eqNullSafe(F.col("conv2")) & F.col("stretch").eqNullSafe(F.col("stretch2")), "left")
    fallen = F.greatest("until", "earlier") > F.col("seq")
    return both.filter(~F.col("dead") & ~F.coalesce(fallen, F.lit(False)))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, n_turns, formatted, mask): mask is an array of (start, length) in code points of formatted."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">\n"))
    own = escape(F.col("text"))
    pieces = messages.select("conv", "stretch", "opened", "id", F.concat(head, own, F.lit(CLOSE)).alias("piece"), F.when(F.col("role").isin(*trained), F.struct(F.length(head).alias("start"), F.length(own).alias("length"))).alias("span"))
    parts = joined(pieces.select("conv", "stretch", F.struct("opened", "id", "piece", F.array_compact(F.array("span")).alias("spans"), F.lit(1).alias("n")).alias("part")), ["conv", "stretch"])
    whole = joined(parts.select("conv", F.struct("stretch", "piece", "spans", "n").alias("part")), ["conv"])
    return whole.select("conv", F.col("n").cast("bigint").alias("n_turns"), F.col("piece").alias("formatted"), F.col("spans").alias("mask"))


def joined(parts: DataFrame, by: list[str]) -> DataFrame:
    """Pieces put together in order, their spans moved to where they stand then."""
    rows = parts.groupBy(*by).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    # Where each part begins; there are few parts of a stretch, and few stretches.
    ends = F.aggregate("parts", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p["piece"]))))
    shifted = F.flatten(F.zip_with(F.col("parts"), F.slice(F.col("ends"), 1, F.size("parts")), lambda p, at: F.transform(p["spans"], lambda s: F.struct((s["start"] + at).alias("start"), s["length"].alias("length")))))
    return rows.withColumn("ends", ends).select(
        *by, F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("piece"), shifted.alias("spans"), F.aggregate("parts", F.lit(0), lambda acc, p: acc + p["n"]).alias("n")
    )


def format_conversations(events: DataFrame, trained: tuple[str, ...] = ("assistant",), **columns) -> DataFrame:
    """(conv, n_turns, formatted, mask) of every conversation of a log of events."""
    return render(final_messages(events, **columns), trained)


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    pieces = F.split(formatted, CLOSE, -1)
    head = lambda p: F.instr(p, ">\n")
    role = lambda p: unescape_role(F.substring(p, len(OPEN) + 1, head(p) - 1 - len(OPEN)))
    text = lambda p: unescape(F.substring(p, head(p) + 2, F.length(p)))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def under_mask(formatted: Column, mask: Column) -> Column:
    """Array of the unescaped texts under the mask; in UTF-32 each is found without walking through what stands before it."""
    wide = F.array(F.encode(formatted, "UTF-32"))
    # A leading mark is read as the order of bytes, so one is put before each text.
    mark = F.unhex(F.lit("0000FEFF"))
    cut = lambda raw, s: unescape(F.decode(F.concat(mark, F.substring(raw, s["start"] * 4 + 1, s["length"] * 4)), "UTF-32"))
    return F.flatten(F.transform(wide, lambda raw: F.transform(mask, lambda s: cut(raw, s))))


def digest(conversations: DataFrame) -> DataFrame:
    """conv and what is read back from formatted and mask: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    found = conversations.select("conv", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(under_mask(F.col("formatted"), F.col("mask")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


#: Code points of a streamed piece of the log made from a table of turns.
PIECE = 64


def log_of(turns: DataFrame) -> DataFrame:
    """A log of events (conv_id, message_id, turn, step, kind, role, text) that folds into the rows of a table of turns.

    Texts of assistants are streamed in pieces. By a hash of the text, some were first streamed backwards and regenerated,
    others edited at the end or deleted and begun anew. Repeated rows become
    messages of their own; rows of one turn stand in the order of role, digest of the text.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", whole.alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    stream = lambda text: F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda x: F.struct(F.lit("delta").alias("kind"), x.alias("text")))
    one = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), text.alias("text")))
    text, empty = F.col("text"), F.lit("")
    draft = stream(F.reverse(text))
    case = F.crc32("text") % 4
    told = (
        F.when(F.col("role").isNull() | (F.col("role") != "assistant"), one("message", text))
        .when(case == 0, F.concat(one("message", empty), draft, one("regenerate", empty), stream(text)))
        .when(case == 1, F.concat(one("message", empty), draft, one("edit", text)))
        .when(case == 2, F.concat(one("message", text), one("delete", empty), draft, one("regenerate", empty), stream(text)))
        .otherwise(F.concat(one("message", empty), stream(text)))
    )
    copies = rows.select("conv_id", "turn", "role", F.md5("text").alias("mark"), told.alias("told"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    events = copies.select("conv_id", F.struct("turn", "role", "mark", "copy").alias("message_id"), "turn", "role", F.posexplode("told").alias("step", "event"))
    return events.select("conv_id", "message_id", "turn", F.col("step").cast("bigint").alias("step"), F.col("event.kind").alias("kind"), "role", F.col("event.text").alias("text"))
