"""Preference formatting of chat pairs: the common turn prefix once as prompt, two masked completions.

Native expressions only. The common prefix is found by aggregates over (pair, turn), which are
combined map-side and spread a long conversation over tasks; only the final strings gather a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Marks around a turn; the opening one is broken up where a text contains it, so that texts can't fake turns.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"
LEARNED = "assistant"


def rendered(turns: DataFrame) -> DataFrame:
    """Adds ``said``, the turn as it is rendered, and ``lead``, the characters before what is learned."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    safe = [F.replace(c, F.lit("<|"), F.lit("< |")) for c in (role, text)]
    said = F.concat(F.lit(OPEN), safe[0], F.lit(MIDDLE), safe[1], F.lit(CLOSE))
    return turns.withColumn("said", said).withColumn("lead", F.length(safe[0]) + len(OPEN) + len(MIDDLE))


def prefix_lengths(turns: DataFrame) -> DataFrame:
    """``(pair_id, fork)``: the first turn number at which the sides differ or one has none; null if they are equal.

    Turns are compared by a 256-bit hash of role and text, so texts don't travel for it.
    """
    said = F.sha2(F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))), 256)
    t = turns.select("pair_id", "turn", "side", F.unhex(said).alias("h"))
    t = t.groupBy("pair_id", "turn").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("h")))).alias(f"s{s}") for s in (0, 1)))
    return t.groupBy("pair_id").agg(F.min(F.when(F.col("s0") != F.col("s1"), F.col("turn"))).alias("fork"))


def swapped(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """Preference pairs of ``turns(conv_id, turn, role, text)``: ``(pair_id, side, turn, role, text)``, one pair a conversation.

    The chosen side is the conversation. The rejected side is the same with its last turn of ``learned`` answered by the text of
    the last such turn of the conversation whose number differs in the lowest bit. Without either turn the sides are equal. Of
    several rows of the last turn's number that are learned, each is answered so. Rows without conversation or turn number are no turns.
    """
    t = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    mine = t.where(F.col("role") == learned).groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    other = mine.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("answer"))
    plan = mine.join(other, "conv_id").select("conv_id", F.col("last.turn").alias("at"), "answer")
    sides = t.join(plan, "conv_id", "left").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when((F.col("side") == 1) & (F.col("role") == learned) & (F.col("turn") == F.col("at")), F.col("answer")).otherwise(F.col("text"))
    return sides.select(F.col("conv_id").alias("pair_id"), "side", "turn", "role", text.alias("text"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair of ``turns(pair_id, side, turn, role, text)``, side 0 chosen and 1 rejected.

    ``(pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask)``: the prompt renders the turns before
    the first that differs in role or text; the completions the rest. Masks are spans [start, end) of a completion, in
    characters, that are learned: texts of the assistant and their end marks. Null roles and texts are empty.
    Rows without pair or turn number are not turns. Several rows of one turn number stand in the order (role, text). A
    missing side has an empty completion and the prompt is then empty. Other columns are not read. An empty table gives no row.
    """
    t = rendered(turns.select("pair_id", "side", "turn", "role", "text").where("pair_id IS NOT NULL AND turn IS NOT NULL"))
    t = t.join(prefix_lengths(t), "pair_id")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    part = F.when(shared, F.lit(2)).otherwise(F.col("side"))
    t = t.where(~shared | (F.col("side") == 0)).withColumn("part", part)
    before = W.Window.partitionBy("pair_id", "part").orderBy("turn", "role", "text").rowsBetween(W.Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("said")).over(before), F.lit(0)))
    span = F.when((F.col("role") == LEARNED) & (F.col("part") < 2), F.struct((F.col("at") + F.col("lead")).cast("long").alias("start"), (F.col("at") + F.length("said")).cast("long").alias("end")))
    t = t.select("pair_id", "part", "at", "said", span.alias("span"))

    def text(p: int):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("at", "said")))), lambda x: x["said"]), "")

    def mask(p: int):
        return F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("span"))))

    return t.groupBy("pair_id").agg(
        F.count_if(F.col("part") == 2).alias("n_prompt_turns"), text(2).alias("prompt"),
        text(0).alias("chosen"), mask(0).alias("chosen_mask"), text(1).alias("rejected"), mask(1).alias("rejected_mask"),
    )
