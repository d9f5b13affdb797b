"""Preference formatting of chosen and rejected conversations.

A pair's longest common prefix of turns is rendered once as its prompt; what
follows on either side is rendered as two completions, with a mark on the
text that a model is to learn. Turns stay rows: a conversation of any length
is never gathered into one task, and the common prefix is found by joining
both sides turn by turn and taking the first difference.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Characters up to which a pair may be assembled into one row.
EXAMPLE_CHARS = 1 << 20


def _ordered(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Turns with a place (turn, nth of equal turn numbers); null turns come last."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1))
    clean = turns.select(*keys, turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # The window only spans rows that repeat one turn number of one conversation.
    again = Window.partitionBy(*keys, "turn").orderBy("role", "text")
    return clean.withColumn("nth", F.row_number().over(again))


def own_reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs out of single conversations: as it is, and with its last reply replaced by its own reply before.

    Columns pair_id, side (chosen or rejected), turn, role, text, one row per
    turn and side up to the last assistant turn. A conversation with a single
    reply is rejected with an empty one; one without replies gives no pair;
    rows without conv_id are left out. Of repeated last turns all are replaced.
    """
    rows = conversations.filter("conv_id is not null").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"), "role", "text")
    replies = rows.filter("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    last = replies.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    before = replies.join(last, "conv_id").filter("turn < last_turn").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("before"))
    ends = last.join(before, "conv_id", "left").select("conv_id", "last_turn", F.coalesce("before.text", F.lit("")).alias("other"))
    known = rows.join(ends, "conv_id").filter("turn <= last_turn")
    swapped = F.when((F.col("turn") == F.col("last_turn")) & (F.col("role") == "assistant"), F.col("other")).otherwise(F.col("text"))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text")), F.struct(F.lit("rejected").alias("side"), swapped.alias("text"))))
    return known.select(F.col("conv_id").alias("pair_id"), "turn", "role", sides.alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Segments of every pair: pair_id, part (prompt, chosen, rejected), turn, nth, role, head, body, learn.

    ``head + body`` is the rendered turn, and ``learn`` says whether ``body``
    counts in training: the assistant turns of the completions. Prompt turns
    come once. The common prefix ends before the first place where role or
    text differ or one side has no turn; equal sides give a prompt only.
    Null role and text are empty, null turns come last, repeated turn numbers
    are ordered by role and text, rows without pair_id or with another side
    are left out, other columns are not read, an empty table gives no rows.
    """
    keys = ["pair_id", "side"]
    turns = _ordered(pairs.filter("pair_id is not null and side in ('chosen', 'rejected')"), keys)
    place = ["pair_id", "turn", "nth"]
    # One row per place with both sides; equal numbers of exchanges whatever the length of a conversation.
    both = turns.groupBy(*place).pivot("side", ["chosen", "rejected"]).agg(F.first(F.struct("role", "text")))
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    fork = both.filter(differs).groupBy("pair_id").agg(F.min(F.struct("turn", "nth")).alias("fork"))
    joined = both.join(fork, "pair_id", "left")
    shared = F.col("fork").isNull() | (F.struct("turn", "nth") < F.col("fork"))

    def piece(part: str, side: str) -> Column:
        return F.struct(F.lit(part).alias("part"), F.col(side).alias("said"))

    parts = F.when(shared, F.array(piece("prompt", "chosen"))).otherwise(F.array(piece("chosen", "chosen"), piece("rejected", "rejected")))
    rows = joined.select(*place, F.explode(parts).alias("p")).filter("p.said is not null").select(*place, "p.part", "p.said.role", "p.said.text")
    return rows.select(
        "pair_id",
        "part",
        "turn",
        "nth",
        "role",
        F.concat(F.lit(OPEN), F.col("role"), F.lit("\n")).alias("head"),
        F.concat(F.col("text"), F.lit(CLOSE + "\n")).alias("body"),
        ((F.col("part") != "prompt") & (F.col("role") == "assistant")).alias("learn"),
    )


def assemble(segments: DataFrame, limit: int = EXAMPLE_CHARS) -> tuple[DataFrame, DataFrame]:
    """One row per pair (prompt, chosen, rejected, and both completions' masked spans), and the segments of pairs above ``limit`` characters."""
    sizes = segments.groupBy("pair_id").agg(F.sum(F.length("head") + F.length("body")).alias("chars"))
    fits = segments.join(sizes.filter(F.col("chars") <= limit).select("pair_id"), "pair_id")
    larger = segments.join(sizes.filter(F.col("chars") > limit).select("pair_id"), "pair_id")
    listed = fits.groupBy("pair_id").pivot("part", ["prompt", "chosen", "rejected"]).agg(F.array_sort(F.collect_list(F.struct("turn", "nth", "head", "body", "learn"))))

    def text(part: str) -> Column:
        return F.array_join(F.transform(F.coalesce(F.col(part), F.array()), lambda s: F.concat(s["head"], s["body"])), "")

    def spans(part: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

        def step(a: Column, s: Column) -> Column:
            low = a["at"] + F.length(s["head"])
            high = low + F.length(s["body"])
            span = F.array(F.struct(low.alias("start"), high.alias("stop")))
            return F.struct(high.alias("at"), F.when(s["learn"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

        return F.aggregate(F.coalesce(F.col(part), F.array()), start, step, lambda a: a["spans"])

    done = listed.select("pair_id", *[text(p).alias(p) for p in ("prompt", "chosen", "rejected")], *[spans(p).alias(f"{p}_spans") for p in ("chosen", "rejected")])
    return done, larger
