"""Preference pairs as prompts with two masked completions, with DataFrame functions only.

``format_preferences`` takes turns (conv_id, turn, role, text) and pairs (chosen_id, rejected_id). The longest common prefix of a
pair ends before the first turn at which the two conversations differ; it is rendered once, as the prompt. What follows is
rendered as the chosen and the rejected completion, each with the spans (start inclusive, end exclusive, in code points of
that completion) that a trainer scores: the text and end mark of the assistant's turns.

``format_preferences`` renders in blocks of ``BLOCK`` turns, so that no step over turns grows with a conversation's length; ``whole_pairs`` joins a pair's blocks into
its one record, with the prompt once and spans relative to the whole completion, as the registered query returns it.

Pairs of a corpus come from ``pairs_by_opening``: of the conversations with equal first turns, the smallest id is the
chosen one of a pair with each other conversation, which is the rejected one. A conversation whose opening is its own is
compared with nothing and has itself as the chosen side, no prefix, and no rejected side. Groups are never collected or paired in full.

Edge cases: a null role is the empty role and a null text the empty text; rows without a conversation or turn number say nothing and
are left out; repeated rows count once, different rows of one turn follow each other by role and text; a conversation that
is a prefix of the other has an empty completion; equal conversations have two empty completions; texts of any length are rendered
whole; equal openings take the smallest id as the chosen one; other columns, of any name, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameline.llm.common import written

BLOCK = 64  # turns of a part in a row
START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def clean_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, said): distinct turns; ``said`` has the rows of a turn in order, each once."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"))
    return rows.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("said")).alias("said"))


def pairs_by_opening(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id) for the conversations of ``clean_turns``; rejected_id is null for openings that occur once."""
    first = turns.groupBy("conv_id").agg(F.min_by("said", "turn").alias("said")).select("conv_id", F.sha2(F.to_json("said"), 256).alias("opening"))
    groups = first.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("many"))
    paired = first.join(groups, "opening").filter((F.col("conv_id") != F.col("chosen_id")) | (F.col("many") == 1))
    return paired.select("chosen_id", F.when(F.col("many") > 1, F.col("conv_id")).alias("rejected_id"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """Spans of the assistant's text and end mark in ``_rendered``."""
    none = F.array().cast("array<struct<start:int,stop:int>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + len(START) + len(MIDDLE) + F.length(t["role"])
        stop = begin + F.length(t["text"]) + len(END)
        own = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, block, prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans).

    ``turns`` are ``clean_turns``; ``prompt_turns`` counts the turns in the row's prompt.
    """
    pairs = written(pairs.distinct(), "pairs")
    both = pairs.filter(F.col("rejected_id").isNotNull())
    digest = F.sha2(F.to_json("said"), 256)
    marked = turns.select("conv_id", "turn", digest.alias("digest"))
    one = both.join(marked.withColumnRenamed("conv_id", "chosen_id"), "chosen_id").withColumn("side", F.lit(1))
    two = both.join(marked.withColumnRenamed("conv_id", "rejected_id"), "rejected_id").withColumn("side", F.lit(2))
    met = one.unionByName(two).groupBy("chosen_id", "rejected_id", "turn").agg(F.count(F.lit(1)).alias("sides"), F.min("digest").alias("a"), F.max("digest").alias("b"))
    differ = met.groupBy("chosen_id", "rejected_id").agg(F.min(F.when((F.col("sides") < 2) | (F.col("a") != F.col("b")), F.col("turn"))).alias("differs_at"))
    alone = pairs.filter(F.col("rejected_id").isNull())
    cut = written(pairs.join(differ, ["chosen_id", "rejected_id"], "left"), "pairs-cut")
    chosen = cut.join(turns.withColumnRenamed("conv_id", "chosen_id"), "chosen_id")
    rejected = cut.join(turns.withColumnRenamed("conv_id", "rejected_id"), "rejected_id")
    shared = F.col("rejected_id").isNotNull() & (F.col("differs_at").isNull() | (F.col("turn") < F.col("differs_at")))
    parts = chosen.select("chosen_id", "rejected_id", "turn", "said", F.when(shared, "prompt").otherwise("chosen").alias("part")).unionByName(
        rejected.filter(~shared).select("chosen_id", "rejected_id", "turn", "said", F.lit("rejected").alias("part"))
    )
    # Blocks are by turn number, so that a turn's block does not depend on the conversation's other turns.
    block = F.floor(F.col("turn") / BLOCK).cast("long")
    rows = parts.withColumn("block", block).groupBy("chosen_id", "rejected_id", "block", "part").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda t: t["said"])).alias("said"), F.count(F.lit(1)).alias("n"))
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("said")))
    wide = rows.groupBy("chosen_id", "rejected_id", "block").agg(of("prompt").alias("p"), of("chosen").alias("c"), of("rejected").alias("r"), F.sum(F.when(F.col("part") == "prompt", F.col("n")).otherwise(0)).alias("prompt_turns"))
    empty = F.array().cast("array<struct<role:string,text:string>>")
    p, c, r = (F.coalesce(x, empty) for x in ("p", "c", "r"))
    missing = F.col("rejected_id").isNull()
    return wide.select(
        "chosen_id", "rejected_id", "block", "prompt_turns",
        _rendered(p).alias("prompt"),
        _rendered(c).alias("chosen"), _spans(c).alias("chosen_spans"),
        F.when(~missing, _rendered(r)).alias("rejected"), F.when(~missing, _spans(r)).alias("rejected_spans"),
    )


def whole_pairs(rows: DataFrame) -> DataFrame:
    """``format_preferences`` with one row for each pair: parts joined in block order, spans moved by what comes before their block."""
    none = F.array().cast("array<struct<start:int,stop:int>>")
    block = F.struct("block", "prompt_turns", "prompt", "chosen", "chosen_spans", "rejected", "rejected_spans")
    held = rows.groupBy("chosen_id", "rejected_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    text = lambda part: F.array_join(F.transform("blocks", lambda b: b[part]), "")

    def spans(part: str) -> Column:
        def step(state: Column, b: Column) -> Column:
            moved = F.transform(F.coalesce(b[f"{part}_spans"], none), lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["stop"] + state["at"]).alias("stop")))
            return F.struct((state["at"] + F.length(F.coalesce(b[part], F.lit("")))).alias("at"), F.concat(state["spans"], moved).alias("spans"))

        return F.aggregate("blocks", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])

    missing = F.col("rejected_id").isNull()
    return held.select(
        "chosen_id", "rejected_id", F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["prompt_turns"]).alias("prompt_turns"),
        text("prompt").alias("prompt"), text("chosen").alias("chosen"), spans("chosen").alias("chosen_spans"),
        F.when(~missing, text("rejected")).alias("rejected"), F.when(~missing, spans("rejected")).alias("rejected_spans"),
    )
