"""Preference pairs for training: one prompt, two masked completions.

A pair holds a chosen and a rejected conversation as arrays of turns. Their longest common prefix
of equal turns (role and text, null equal to null) is rendered once as the prompt. The rest of
each side is rendered as its completion with spans (first character, one past the last) of the
text that training counts: the turns of the assistant, their end mark included. Everything is
DataFrame expressions on one row per pair; nothing is shuffled here.

Null conversations are empty. A pair whose sides are equal, or have no assistant text after the
prompt on both sides, is kept with ``usable`` false. Null roles render as empty ones, null texts
as empty; repeated pairs and extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN = "array<struct<role:string,text:string>>"
#: Fixed values of the rendering: what opens a turn (before and after the role) and what ends it.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of equal turns at the start of both arrays."""
    n = F.least(F.size(chosen), F.size(rejected))
    same = F.zip_with(F.slice(chosen, F.lit(1), n), F.slice(rejected, F.lit(1), n),
                      lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(n).cast("int")


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, _turn))


def spans(turns: Column, role: str = "assistant") -> Column:
    """Character spans of the ``role``'s texts with their end marks in ``render(turns)``."""
    def step(acc: Column, t: Column) -> Column:
        size = F.length(_turn(t))
        head = F.length(F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit(MIDDLE)))
        span = F.struct((acc["at"] + head).alias("first"), (acc["at"] + size).alias("end"))
        more = F.when(t["role"].eqNullSafe(role), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + size).alias("at"), more.alias("spans"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("spans"))
    return F.aggregate(turns, empty, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """``pairs`` with n_prompt_turns, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask
    and usable, instead of the two turn arrays (columns of these names are replaced)."""
    empty = F.array().cast(TURN)
    base = pairs.withColumns({chosen_col: F.coalesce(F.col(chosen_col).cast(TURN), empty), rejected_col: F.coalesce(F.col(rejected_col).cast(TURN), empty)})
    n = common_turns(F.col(chosen_col), F.col(rejected_col))
    base = base.withColumn("n_prompt_turns", n)
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(F.col(c)), F.lit(1)))
    base = base.withColumns({"prompt": render(F.slice(F.col(chosen_col), F.lit(1), F.col("n_prompt_turns"))),
                             chosen_col: rest(chosen_col), rejected_col: rest(rejected_col)})
    base = base.withColumns({"chosen_text": render(F.col(chosen_col)), "chosen_mask": spans(F.col(chosen_col)),
                             "rejected_text": render(F.col(rejected_col)), "rejected_mask": spans(F.col(rejected_col))})
    base = base.withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))
    return base.drop(*({chosen_col, rejected_col} - {"chosen_text", "rejected_text"}))


def conversation_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) from (conv_id, turn, role, text) rows: a conversation is one row, as long
    as itself; its turns stand in the order of their numbers, equal numbers by role and text."""
    each = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(
        F.transform(each, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen_id, rejected_id, chosen, rejected) from conversations.

    Conversations that open with the same turn answer the same question: the one with the most
    assistant characters (of equal ones the least id) is chosen over each other one of them, so a
    group of n gives n - 1 pairs. A conversation with two assistant turns or more also gives a
    pair of its own, in which its last assistant turn is rejected by repeating the one before.
    """
    conv = conversation_arrays(turns).withColumns({
        "opening": F.md5(F.to_json(F.col("turns")[0])),
        "weight": F.aggregate("turns", F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.coalesce(F.length(t["text"]), F.lit(0))).otherwise(0))})
    best = conv.groupBy("opening").agg(F.count("*").alias("n"), F.max_by("conv_id", F.struct("weight", -F.col("conv_id"))).alias("chosen_id")).where("n > 1")
    of_best = best.join(conv.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id").select("opening", "chosen_id", "chosen")
    shared = conv.join(of_best, "opening").where("conv_id <> chosen_id").select(
        F.concat(F.lit("shared-"), F.col("conv_id")).alias("pair_id"), "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))
    place = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    own = conv.select("conv_id", "turns", place.alias("at")).where(F.size("at") > 1)
    last, before = F.element_at("at", -1), F.element_at("at", -2)
    stale = F.concat(F.slice("turns", F.lit(1), last), F.array(F.element_at("turns", before + 1)))
    own = own.select(F.concat(F.lit("stale-"), F.col("conv_id")).alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
                     F.slice("turns", F.lit(1), last + 1).alias("chosen"), stale.alias("rejected"))
    return shared.unionByName(own)
