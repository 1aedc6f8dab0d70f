"""Chat formatting by prefix-target expansion (DataFrame functions only).

A turn is written as ``### <role>: <text> </turn>\\n``.  Inside roles and texts the characters
``\\``, ``#`` and ``<`` (in roles also ``:``) get a backslash before them, so neither ``### ``
nor ``</turn>`` can occur there, and removing one backslash before each escaped character gives
the text back.

Every assistant turn becomes an example of its own: all preceding turns are its context and only
its reply is trainable.  Because each context is a prefix of the same stream, the stream is stored
once, turn by turn with character offsets, and an example is three numbers: where its context
ends, and where its trainable reply starts and ends.  The output thus grows with the input even
for a conversation of a million turns; :func:`expand` writes examples out in full.

Defined results: a null text or role is empty; rows of a null ``conv_id`` are one conversation;
ties in ``turn`` (nulls first) are ordered by role and text; repeated rows are separate turns; an
empty table gives an empty output; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 512
TARGET_ROLE = "assistant"
_FOOT = " </turn>\n"


def _escape(c, more: str = ""):
    return F.regexp_replace(c, rf"([\\#<{more}])", r"\\$1")


def _unescape(c):
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id, seq, formatted, start, target, example, target_start, target_end``.

    ``start`` is the turn's place in its conversation's stream.  For a target turn the example is
    ``stream[0:target_end]`` with the loss on ``[target_start, target_end)``; ``example`` counts
    the conversation's examples from 0.

    Offsets are running sums in two levels, over blocks of turns and inside a block, so that no
    task has to order a whole conversation.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 53))).alias("block"),
    )
    head = F.concat(F.lit("### "), _escape("role", ":"), F.lit(": "))
    rows = rows.withColumns({"head": head, "body": _escape("text"), "target": F.col("role") == TARGET_ROLE})
    rows = rows.withColumn("formatted", F.concat("head", "body", F.lit(_FOOT)))
    rows = rows.withColumns({"n": F.length("formatted").cast("long"), "head_n": F.length("head"), "body_n": F.length("body"), "hit": F.col("target").cast("long")})
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = rows.select("conv_id", "block", "formatted", "target", "n", "head_n", "body_n", (F.row_number().over(inside) - 1).cast("long").alias("k"), zero(F.sum("n").over(before)).alias("at"), zero(F.sum("hit").over(before)).alias("hits"))
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("k0"), F.sum("n").alias("at0"), F.sum("hit").alias("hits0"))
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *(zero(F.sum(x).over(over)).alias(x) for x in ("k0", "at0", "hits0")))
    at = F.col("at") + F.col("at0")
    return local.join(blocks, local.conv_id.eqNullSafe(blocks.c) & (local.block == blocks.b)).select(
        "conv_id",
        (F.col("k") + F.col("k0")).alias("seq"),
        "formatted",
        at.alias("start"),
        "target",
        F.when(F.col("target"), F.col("hits") + F.col("hits0")).alias("example"),
        F.when(F.col("target"), at + F.col("head_n")).alias("target_start"),
        F.when(F.col("target"), at + F.col("head_n") + F.col("body_n")).alias("target_end"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """``conv_id, example, context_end, target_start, target_end``: one row per example.

    Its context is ``stream[0:context_end]``, its trainable reply ``stream[target_start:target_end]``.
    """
    return turns.where("target").select("conv_id", "example", F.col("start").alias("context_end"), "target_start", "target_end")


def with_examples(stream: DataFrame, examples: DataFrame) -> DataFrame:
    """``stream(conv_id, seq, start, formatted)`` with the spans of the examples, as :func:`parse_turns` takes it.

    Each example finds its reply where its context ends, so trainable text comes from examples alone.
    """
    e = examples.select(F.col("conv_id").alias("c"), "context_end", "target_start", "target_end")
    found = stream.join(e, stream.conv_id.eqNullSafe(e.c) & (stream.start == e.context_end), "left")
    return found.select("conv_id", "seq", "formatted", "start", F.col("context_end").isNotNull().alias("target"), "target_start", "target_end")


def expand(turns: DataFrame) -> DataFrame:
    """Examples in full: ``conv_id, example, text, target_start, target_end``.

    The size of the result is the sum of all prefixes; use it for chosen conversations.
    """
    ends = turns.where("target").select(F.col("conv_id").alias("c"), F.col("seq").alias("last"), F.col("example").alias("no"), F.col("target_start").alias("a"), F.col("target_end").alias("z"))
    joined = turns.join(ends, turns.conv_id.eqNullSafe(ends.c) & (turns.seq <= ends.last))
    parts = joined.groupBy("conv_id", "no", "a", "z").agg(F.sort_array(F.collect_list(F.struct("seq", "formatted"))).alias("p"))
    return parts.select("conv_id", F.col("no").alias("example"), F.expr("substring(array_join(transform(p, x -> x.formatted), ''), 1, cast(z as int))").alias("text"), F.col("a").alias("target_start"), F.col("z").alias("target_end"))


def parse_turns(turns: DataFrame) -> DataFrame:
    """Roles, texts and trainable replies read back from the formatted stream."""
    role = F.regexp_extract("formatted", r"(?s)^### ((?:[^\\:]|\\.)*): ", 1)
    skip = F.length("role_raw") + 6
    parsed = turns.withColumn("role_raw", role)
    return parsed.select(
        "conv_id",
        "seq",
        "start",
        F.length("formatted").cast("long").alias("n_chars"),
        _unescape(F.col("role_raw")).alias("role"),
        _unescape(F.expr(f"substring(formatted, length(role_raw) + 7, length(formatted) - length(role_raw) - {6 + len(_FOOT)})")).alias("text"),
        F.when(F.col("target"), _unescape(F.expr("substring(formatted, cast(target_start - start as int) + 1, cast(target_end - target_start as int))"))).alias("reply"),
        skip.alias("head_chars"),
    ).drop("head_chars")


def digest(parsed: DataFrame) -> DataFrame:
    """Per conversation: turn count, digests of its turns and of all text under the loss mask."""
    turn = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    rows = parsed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("seq", turn.alias("t"), F.coalesce("reply", F.lit("")).alias("r")))).alias("s"),
        F.sum("n_chars").alias("formatted_chars"),
    )
    rows = rows.select("conv_id", "n_turns", "formatted_chars", F.expr("array_join(transform(s, x -> x.t), '')").alias("turns"), F.expr("array_join(transform(s, x -> x.r), '')").alias("loss"))
    return rows.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
