"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation is written once, turn by turn, as ``<s>[INST]role[/INST]text</s>``; ``format_turns`` returns these
segments with their code point offsets. Every assistant turn then becomes an example of its own: all text before
it as context, and a loss mask over that reply alone. An example is always a prefix of its conversation, so
``prefix_targets`` states it as a length and a mask span over the stored segments and the output stays linear in
the input however long a conversation is; ``example_texts`` spells chosen examples out.

Control strings in a role or a text are escaped (``ESCAPES``), so the segments can be parsed back exactly.

Defined cases: null text or role is the empty string; a null turn number sorts first; equal turn numbers follow role,
then text, and repeated rows are all kept; a null conv_id is a conversation of its own; other columns are
ignored; an empty table gives empty outputs. Turns after the last assistant turn, or a conversation without
one, give a last example with no target (null mask).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Escape of each control string; the backslash itself comes first when escaping and last when undoing.
ESCAPES = [("\\", "\\b"), (BEGIN, "\\s"), (END, "\\e"), (OPEN, "\\i"), (CLOSE, "\\j")]


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Segments: conv_id, seq (from 0), role, segment, seg_start, seg_end, is_target, loss_start, loss_end.

    Offsets count code points of the whole formatted conversation.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    body = rows.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit(BEGIN + OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = body.select(
        "conv_id", "role", "head", "body",
        (F.row_number().over(by_turn) - 1).alias("seq"),
        F.sum(F.length("head") + F.length("body") + len(END)).over(upto).cast("long").alias("seg_end"),
    )
    is_target = F.col("role") == target_role
    loss_end = F.col("seg_end") - len(END)
    return placed.select(
        "conv_id", "seq", "role", F.concat("head", "body", F.lit(END)).alias("segment"),
        (loss_end - F.length("head") - F.length("body")).alias("seg_start"), "seg_end",
        is_target.alias("is_target"),
        F.when(is_target, loss_end - F.length("body")).alias("loss_start"),
        F.when(is_target, loss_end).alias("loss_end"),
    )


def prefix_targets(segments: DataFrame) -> DataFrame:
    """One example per assistant turn: conv_id, example_no, n_turns, n_chars, loss_start, loss_end.

    ``n_chars`` is the length of the example's text, a prefix of the formatted conversation; only code points
    from loss_start to loss_end are trainable, so preceding replies are context.
    """
    by_conv = Window.partitionBy("conv_id")
    last = F.col("seq") == F.max("seq").over(by_conv)
    ended = segments.withColumn("_last", last).where(F.col("is_target") | F.col("_last"))
    number = F.row_number().over(by_conv.orderBy("seq")) - 1
    return ended.select(
        "conv_id", number.alias("example_no"), (F.col("seq") + 1).alias("n_turns"),
        F.col("seg_end").alias("n_chars"), "loss_start", "loss_end",
    )


def example_texts(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """Spell out examples: the given rows with ``text``. Meant for a batch of examples at a time, since the text of
    all examples of a conversation grows with the square of its turns."""
    key = segments.select(F.col("conv_id").alias("_conv"), "seq", "segment")
    joined = examples.join(key, (F.col("conv_id").eqNullSafe(F.col("_conv"))) & (F.col("seq") < F.col("n_turns")))
    return joined.groupBy(*examples.columns).agg(
        F.sort_array(F.collect_list(F.struct("seq", "segment"))).alias("_parts")
    ).select(*examples.columns, F.array_join(F.col("_parts.segment"), "").alias("text"))


def read_back(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """Digest of the output, parsed from the formatted text and the masks alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, example_chars. A sha-256
    is sequential, so one conversation's text meets in one row here (and only here).
    """
    streams = segments.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "segment"))).alias("parts")
    ).select("conv_id", F.array_join(F.col("parts.segment"), "").alias("stream"))
    masks = examples.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("loss_start", "loss_end"))))
        .alias("masks"),
        F.count("*").alias("n_examples"), F.sum("n_chars").alias("example_chars"),
    ).withColumnRenamed("conv_id", "_conv")
    both = streams.join(masks, F.col("conv_id").eqNullSafe(F.col("_conv")))
    pieces = F.filter(F.split("stream", END, -1), lambda s: s != "")
    head = F.lit(len(BEGIN + OPEN) + 1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, CLOSE)
        role = F.substring(piece, head, at - head)
        text = F.substring(piece, at + len(CLOSE), F.length(piece))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    read = both.select(
        "conv_id", F.transform(pieces, turn).alias("turns"),
        F.array_join(
            F.transform("masks", lambda m: unescape(
                F.substring(F.col("stream"), (m["loss_start"] + 1).cast("int"),
                            (m["loss_end"] - m["loss_start"]).cast("int")))), "").alias("loss"),
        F.length("stream").cast("long").alias("formatted_chars"), "n_examples", "example_chars",
    )
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "n_examples", "example_chars",
    )
