"""Preference formatting of paired conversations, with DataFrame functions only.

A pair is a chosen and a rejected conversation.  The longest common prefix of their turns is rendered once, as the
prompt; what follows it on either side is that side's completion, in which only the assistant's turns bear loss.

Work stays on rows of one turn each: the prefix ends at the smallest turn where the sides differ, which is a minimum
over pairs (combined before the shuffle), so a conversation of any length is never gathered in one task.  `assemble`
makes one row a pair for the usual case where a conversation fits in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = ("<|", "|>\n", "\n")


def render(role: Column, text: Column, template: tuple[str, str, str] = TEMPLATE) -> Column:
    """A turn as text: role between the first two marks, its text, the third mark.  A null role or text is empty."""
    a, b, c = (F.lit(x) for x in template)
    return F.concat(a, F.coalesce(role, F.lit("")), b, F.coalesce(text, F.lit("")), c)


def turn_rows(turns: DataFrame, side_of: dict[str, Column], pair: Column) -> DataFrame:
    """(pair_id, side, conv_id, turn, n, role, text): repeated rows of a turn are one; different rows of the same turn are
    kept in order of role and text, as n = 0, 1 ...  Rows with a null conversation or turn belong nowhere and go."""
    side = F.coalesce(*[F.when(c, F.lit(k)) for k, c in side_of.items()])
    rows = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(pair.alias("pair_id"), side.alias("side"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    # One turn's different rows are few; the whole conversation is never gathered here.
    merged = rows.where(F.col("side").isNotNull()).groupBy("pair_id", "side", "conv_id", "turn").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("said"))
    return merged.select("pair_id", "side", "conv_id", "turn", F.posexplode("said").alias("n", "one")).select("pair_id", "side", "conv_id", "turn", "n", "one.role", "one.text")


def preference_segments(turns: DataFrame, side_of: dict[str, Column], pair: Column, trained_roles: tuple[str, ...] = ("assistant",), template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """One row for each rendered turn: pair_id, part (prompt, chosen or rejected), turn, n, role, segment, n_bytes, loss.

    `side_of`: which rows are of the chosen and which of the rejected side; `pair`: the pair's id.  `loss` is true in
    completions for `trained_roles`.  A pair of two equal conversations is all prompt.  A pair that lacks a side has no
    common prefix: all of it is that side's completion.  No turns give no rows.
    """
    rows = turn_rows(turns, side_of, pair)
    key = ["pair_id", "turn", "n"]
    # The same turn with the same words on both sides is shared; a turn of one side only is where the sides part.
    said = rows.groupBy(*key, "role", "text").agg(F.min("side").alias("first"), F.max("side").alias("last"))
    cut = said.where(F.col("first") == F.col("last")).groupBy("pair_id").agg(F.min(F.struct("turn", "n")).alias("cut"))
    cuts = rows.join(cut, "pair_id", "left").withColumn("shared", F.col("cut").isNull() | (F.struct("turn", "n") < F.col("cut")))
    part = F.when(F.col("shared"), F.lit("prompt")).otherwise(F.col("side"))
    segment = render(F.col("role"), F.col("text"), template)
    kept = cuts.where(~F.col("shared") | (F.col("side") == "chosen"))  # the common turns once
    return kept.select(
        "pair_id", part.alias("part"), "turn", F.col("n").cast("int").alias("n"), "role", segment.alias("segment"), F.octet_length(segment).cast("long").alias("n_bytes"),
        (~F.col("shared") & F.col("role").isin(*trained_roles)).alias("loss"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """One row a pair: pair_id, prompt, chosen, rejected, and for each completion the (start, end) byte spans that bear
    loss.  For pairs that fit in a row; `preference_segments` itself has no such bound."""
    ordered = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("turn", "n", "segment", "n_bytes", "loss"))))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["segment"]), "")

    def spans(c: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x["n_bytes"]).alias("at"), F.when(x["loss"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + x["n_bytes"]).alias("end"))))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(c, start, step, lambda acc: acc["out"])

    g = segments.groupBy("pair_id").agg(*[ordered(p).alias(p) for p in ("prompt", "chosen", "rejected")])
    return g.select("pair_id", *[text(F.col(p)).alias(p) for p in ("prompt", "chosen", "rejected")], spans(F.col("chosen")).alias("chosen_loss"), spans(F.col("rejected")).alias("rejected_loss"))


def neighbouring_pairs(turns: DataFrame) -> DataFrame:
    """The segments of the pairs (conversation 2k chosen, 2k+1 rejected), with pair_id k."""
    even = F.pmod(F.col("conv_id"), F.lit(2)) == 0
    return preference_segments(turns, {"chosen": even, "rejected": ~even}, F.floor(F.col("conv_id") / F.lit(2)).cast("long"))
