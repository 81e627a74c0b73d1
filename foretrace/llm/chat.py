r"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of messages: ``start``, ``delta`` (more text), ``edit`` (the
whole text anew) and ``regenerate`` (the text starts again). Events are ordered
by their sequence within (conversation, message); folded, they give the final
messages, which are ordered by position and rendered with a template that marks
turns. Texts and roles are escaped, so no mark can occur inside them, and the
escaping is reversible.

Messages are folded first, spread over (conversation, message), so a long
conversation's events never meet in one task; only its final messages do, in
the one string that rendering has to give.

Defined results: a null text or role counts as empty; a message whose events
are all ``start`` is an empty turn; events of the same sequence are ordered by
kind and text; rows with a null conversation form one conversation; repeated
events apply twice, repeated rows of a table of turns are turns of their own.
An empty log gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import bound

# Marks of the template; both begin with a character that escaping removes.
TURN, END = "<|turn|>", "<|end|>\n"
# Characters that control strings of chat templates begin with, and the escape character itself, first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("\n", "&nl;"))


def escaped(text: Column, line_breaks: bool = False) -> Column:
    """Text without the first character of any control string; roles also lose line breaks."""
    for plain, safe in ESCAPES if line_breaks else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``."""
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, position, role, text) of a log.

    ``log`` has conv_id, message, seq, kind, position, role and text. The text
    is what deltas say after the last event that begins it anew.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    folded = log.groupBy("conv_id", "message").agg(
        F.min("position").alias("position"), F.max(F.coalesce("role", F.lit(""))).alias("role"),
        F.array_sort(F.collect_list(event)).alias("events"),
    )
    begins = F.transform("events", lambda e: e["kind"].isin("start", "edit", "regenerate"))
    # Index of the last beginning: where true first occurs in the reversed flags.
    after = F.array_position(F.reverse(begins), True)
    tail = F.when(after > 0, F.slice("events", F.greatest(F.size("events") - after + 1, F.lit(1)).cast("int"), F.size("events"))).otherwise(F.col("events"))
    says = F.transform(tail, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))
    return folded.select("conv_id", "message", "position", "role", F.array_join(says, "").alias("text"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and the loss mask.

    ``loss_spans`` has, for each turn in order, the start and length in code
    points of the part the loss is taken of, counted from that turn's mark;
    length 0 where the turn is not trained on.
    """
    role, text = escaped(F.coalesce("role", F.lit("")), True), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit("\n"))
    length = F.when(F.col("role") == trained_role, F.char_length(text)).otherwise(F.lit(0))
    turn = messages.select("conv_id", F.struct(
        "position", "message", F.concat(head, text, F.lit(END)).alias("turn"),
        F.struct(F.char_length(head).alias("start"), F.coalesce(length, F.lit(0)).alias("length")).alias("span"),
    ).alias("t"))
    return turn.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select(
        "conv_id", F.array_join("turns.turn", "").alias("formatted"), F.col("turns.span").alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns and trained texts parsed from ``formatted`` and ``loss_spans``.

    Adds ``turns`` (role, text, unescaped) and ``loss_texts``, in order.
    """
    pieces = F.split("formatted", r"(?<=<\|end\|>\n)(?=<\|turn\|>)")
    body = lambda t: F.substring(t, F.lit(len(TURN) + 1), F.char_length(t) - len(TURN) - len(END))
    at = lambda b: F.locate("\n", b)
    turn = lambda t: bound(body(t), lambda b: F.struct(
        unescaped(F.substring(b, F.lit(1), at(b) - 1)).alias("role"),
        unescaped(F.substring(b, at(b) + 1, F.char_length(b))).alias("text"),
    ))
    return rendered.withColumn("pieces", pieces).select(
        *rendered.columns, F.transform("pieces", turn).alias("turns"),
        F.transform(
            F.filter(F.arrays_zip("pieces", "loss_spans"), lambda z: z["loss_spans"]["length"] > 0),
            lambda z: unescaped(F.substring(z["pieces"], z["loss_spans"]["start"] + 1, z["loss_spans"]["length"])),
        ).alias("loss_texts"),
    )


def event_log(turns: DataFrame, delta_chars: int = 400) -> DataFrame:
    """The log a chat service would have written for a table of turns.

    Every row becomes a message: it starts with a draft that an abandoned
    generation left, is regenerated, and streams in deltas of ``delta_chars``.
    Rows that share conversation and turn are told apart by role and text, and
    by a number where all of it is equal.
    """
    same = turns.groupBy("conv_id", "turn", "role", "text").count()
    row = same.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy"))
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64("text").alias("text_key"), F.md5(F.col("text").cast("binary")).alias("digest"), "copy")
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length("text") / delta_chars).cast("int") - 1, F.lit(0))),
        lambda i: F.struct((i + 3).alias("seq"), F.lit("delta").alias("kind"), F.substring("text", i * delta_chars + 1, F.lit(delta_chars)).alias("text")),
    )
    draft = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("start").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.substring("text", 1, 8).alias("text")),
        F.struct(F.lit(2).alias("seq"), F.lit("regenerate").alias("kind"), F.lit("").alias("text")),
    )
    full = row.withColumn("text", F.coalesce("text", F.lit("")))
    return full.select(
        "conv_id", message.alias("message"), F.col("turn").alias("position"), F.coalesce("role", F.lit("")).alias("role"),
        F.inline(F.concat(draft, pieces)),
    )


def digests(read: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
