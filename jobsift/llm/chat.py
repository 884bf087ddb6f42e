"""Operator 3 [native] — preference formatting of chat conversations.

A pair is a chosen and a rejected conversation.  Their longest common prefix of
turns (equal role and text) is rendered once as the prompt; what follows is
rendered as two completions with a mask that trains on the assistant's turns
only.  Turns meet in one grouping by pair, whose rows are the turns of two
conversations; the rest is array expressions on one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chat markup around a role and a text, and the role whose turns are trained.
OPEN, AFTER_ROLE, CLOSE, TRAINED = "<|im_start|>", "\n", "<|im_end|>\n", "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(AFTER_ROLE))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Runs of characters, in order, that cover the rendered turns: (length, trained)."""
    runs = lambda t: F.array(
        F.struct(F.char_length(_header(t)).alias("length"), F.lit(False).alias("trained")),
        F.struct(F.char_length(_body(t)).alias("length"), (F.coalesce(t["role"], F.lit("")) == TRAINED).alias("trained")),
    )
    return F.flatten(F.transform(turns, runs))


def common_prefix(a: str, b: str) -> Column:
    """Number of leading turns that agree in role and text."""
    return F.expr(f"""
        if(least(size({a}), size({b})) = 0, 0, coalesce(array_min(filter(
            sequence(0, least(size({a}), size({b})) - 1),
            i -> NOT ({a}[i].role <=> {b}[i].role AND {a}[i].text <=> {b}[i].text))), least(size({a}), size({b}))))
    """)


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair: prompt, the two completions with their masks, and counts.

    ``turns`` has pair_id, chosen (boolean), turn, role, text.  Turns are
    ordered by turn, role, text (ties and repeated turns have a defined place;
    null turns come first); null roles and texts render as empty ones and equal
    only each other.  A pair with one side has no common prefix and an empty
    other side; two equal conversations are all prompt.  Rows without pair_id
    belong to no pair and are left out.  An empty table gives an empty table;
    further columns are not read.
    """
    pairs = turns.where(F.col("pair_id").isNotNull()).groupBy("pair_id")
    return format_sides(pairs.agg(_sorted_turns(F.col("chosen")).alias("c"), _sorted_turns(~F.col("chosen")).alias("r")))


def _sorted_turns(wanted: Column) -> Column:
    return F.sort_array(F.collect_list(F.when(wanted, F.struct("turn", "role", "text"))))


def format_sides(pairs: DataFrame) -> DataFrame:
    """As :func:`format_pairs`, of rows (pair_id, c, r) that hold the turns of both sides in order."""
    pairs = pairs.withColumn("k", common_prefix("c", "r"))
    rest = lambda x: F.expr(f"slice({x}, k + 1, greatest(size({x}) - k, 0))")
    return pairs.select(
        "pair_id", F.col("k").alias("prompt_turns"), F.size("c").alias("chosen_turns"), F.size("r").alias("rejected_turns"),
        render(F.expr("slice(c, 1, k)")).alias("prompt"),
        render(rest("c")).alias("chosen"), render(rest("r")).alias("rejected"),
        mask(rest("c")).alias("chosen_mask"), mask(rest("r")).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Pairs (pair_id, c, r) for a table without preferences, one per conversation with a reply.

    Chosen is a conversation up to its last reply, rejected the same turns with
    the last reply of its neighbour (conv_id 2k for 2k + 1 and the reverse) in
    that place, or nothing if the neighbour has none.  Both stand in one row of
    one grouping.  Rows without conv_id belong to no conversation and are left
    out.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).withColumn("conv_id", F.col("conv_id").cast("long"))
    odd = F.col("conv_id").bitwiseAND(1) == 1
    both = rows.groupBy(F.shiftright("conv_id", 1).alias("k")).agg(_sorted_turns(~odd).alias("t0"), _sorted_turns(odd).alias("t1"))
    last = lambda t: F.expr(f"array_max(filter(sequence(0, greatest(size({t}) - 1, 0)), i -> get({t}, i).role = '{TRAINED}'))")
    both = both.withColumn("l0", last("t0")).withColumn("l1", last("t1"))

    def pair(own: int) -> Column:
        t, at, other = f"t{own}", f"l{own}", f"if(l{1 - own} IS NULL, array(), array(get(t{1 - own}, l{1 - own})))"
        return F.when(F.col(at).isNotNull(), F.struct(
            (F.col("k") * 2 + own).alias("pair_id"), F.expr(f"slice({t}, 1, {at} + 1)").alias("c"), F.expr(f"concat(slice({t}, 1, {at}), {other})").alias("r")))

    return both.select(F.explode(F.array(pair(0), pair(1))).alias("p")).where("p IS NOT NULL").select("p.*")


def mask_text(runs: str) -> Column:
    """A mask as text: ``12-`` for twelve characters that aren't trained, ``30+`` for thirty that are."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["length"].cast("string"), F.when(r["trained"], "+").otherwise("-"))), ",")
