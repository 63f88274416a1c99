"""Chat rendering of multi-turn conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import BOS, TURN_START, chat_turn, py_strip

#: Turn numbers that one task orders at once.
TURN_BLOCK = 4096


def render_turns(
    df: DataFrame,
    add_generation_prompt: bool = False,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = TURN_BLOCK,
) -> DataFrame:
    """``(conv_id, turn, place, piece, ok, reason)``, one row per turn: conversations too long for one string.

    The pieces of a conversation in the order of ``place`` make the prompt of ``render_chat``; the rules are
    the same, and a piece is null where the conversation is not ``ok``. A leading system message gives the piece
    that opens the prompt. Nothing is gathered: turns are ordered inside blocks of ``block`` turn numbers,
    and what a turn must know of its whole conversation (its place, the first role, whether all is well) comes
    from one row per block. So a conversation that holds a third of all turns is spread over its blocks.
    """
    rows = df.select(
        F.col(conv).alias("_conv"),
        F.col(turn).alias("_turn"),
        F.col(role).alias("_role"),
        F.col(text).alias("_text"),
        F.floor(F.col(turn) / F.lit(block)).alias("_block"),
    )
    in_block = Window.partitionBy("_conv", "_block").orderBy("_turn", "_role", "_text")
    rows = rows.withColumn("_nth", F.row_number().over(in_block) - 1)
    even = F.coalesce((F.col("_role") == "user") == (F.col("_nth") % 2 == 0), F.lit(False))
    odd = F.coalesce((F.col("_role") == "user") == (F.col("_nth") % 2 == 1), F.lit(False))
    first = F.col("_nth") == 0
    blocks = rows.groupBy("_conv", "_block").agg(
        F.count("*").alias("_n"),
        F.count_if(~even).alias("_wrong_even"),
        F.count_if(~odd).alias("_wrong_odd"),
        F.max(F.when(first, F.col("_role"))).alias("_first_role"),
        F.max(F.when(first, F.col("_text"))).alias("_first_text"),
        F.count_if(F.col("_text").isNull()).alias("_holes"),
    )
    ordered = Window.partitionBy("_conv").orderBy("_block")
    whole = Window.partitionBy("_conv")
    before = F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"_before": before, "_blocks": F.row_number().over(ordered)})
    system = F.coalesce(F.max(F.when(F.col("_blocks") == 1, F.col("_first_role") == "system")).over(whole), F.lit(False))
    blocks = blocks.withColumn("_system", system)
    # the places after a system message count from it, which makes its own place one where no user may stand
    shifted = (F.col("_before") - F.col("_system").cast("int")) % 2 != 0
    wrong = F.when(shifted, F.col("_wrong_odd")).otherwise(F.col("_wrong_even"))
    blocks = blocks.withColumns(
        {
            "_wrong": F.sum(wrong).over(whole),
            "_holed": F.sum("_holes").over(whole) > 0,
            "_total": F.sum("_n").over(whole),
        }
    )
    # the second turn may open another block than the system message before it
    message = F.max(F.when(F.col("_blocks") == 1, F.col("_first_text"))).over(whole)
    blocks = blocks.withColumn("_message", F.when((F.col("_before") <= 1) & F.col("_system"), message))
    facts = blocks.select(
        F.col("_conv").alias("_c"), F.col("_block").alias("_b"), "_before", "_system", "_wrong", "_holed", "_total", "_message"
    )
    same = F.col("_conv").eqNullSafe(F.col("_c")) & F.col("_block").eqNullSafe(F.col("_b"))
    rows = rows.join(facts, same).withColumn("_place", (F.col("_before") + F.col("_nth")).cast("bigint"))
    opens, lead = F.col("_place") == 0, F.col("_system") & (F.col("_place") == 0)
    prefix = F.when(F.col("_system") & (F.col("_place") == 1), F.concat("_message", F.lit("\n\n"))).otherwise(F.lit(""))
    name = F.when(F.col("_role") == "assistant", F.lit("model")).otherwise(F.col("_role"))
    piece = F.concat(
        F.when(opens, F.lit(BOS)).otherwise(F.lit("")),
        F.when(lead, F.lit("")).otherwise(chat_turn(name, F.concat(prefix, py_strip(F.col("_text"))))),
        F.when(
            F.lit(add_generation_prompt) & (F.col("_place") == F.col("_total") - 1), F.lit(f"{TURN_START}model\n")
        ).otherwise(F.lit("")),
    )
    alternate = F.col("_wrong") == 0
    ok = alternate & ~F.col("_holed")
    reason = F.when(F.col("_holed"), F.lit("a turn has no text")).when(~alternate, F.lit("roles do not alternate"))
    return rows.select(
        F.col("_conv").alias(conv),
        F.col("_turn").alias(turn),
        F.col("_place").alias("place"),
        F.when(ok, piece).alias("piece"),
        ok.alias("ok"),
        reason.alias("reason"),
    )


def render_chat(
    df: DataFrame,
    add_generation_prompt: bool = False,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``(conv_id, prompt, ok, reason)``, one row per conversation.

    A leading system message goes, with a blank line, before the text of the first
    other turn. After it, turns must alternate and start with the user, and no turn may
    lack its text; where that fails, ``prompt`` is null, ``ok`` false and ``reason`` says
    why, to be parted with ``split_rejects``.
    """
    turns = F.array_sort(
        F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))
    )
    gathered = df.groupBy(conv).agg(turns.alias("_turns"))
    opens_with_system = F.coalesce(F.get("_turns", F.lit(0))["role"] == "system", F.lit(False))
    skip = opens_with_system.cast("int")
    gathered = gathered.withColumns(
        {
            "_prefix": F.when(opens_with_system, F.concat(F.get("_turns", F.lit(0))["text"], F.lit("\n\n"))).otherwise(
                F.lit("")
            ),
            "_holed": F.exists("_turns", lambda t: t["text"].isNull()),
            "_turns": F.slice("_turns", skip + 1, F.size("_turns")),
        }
    )
    fine = F.transform("_turns", lambda t, i: F.coalesce((t["role"] == "user") == (i % 2 == 0), F.lit(False)))
    pieces = F.transform(
        "_turns",
        lambda t, i: chat_turn(
            F.when(t["role"] == "assistant", F.lit("model")).otherwise(t["role"]),
            F.concat(F.when(i == 0, F.col("_prefix")).otherwise(F.lit("")), py_strip(t["text"])),
        ),
    )
    prompt = F.concat(
        F.lit(BOS),
        F.array_join(pieces, ""),
        F.lit(f"{TURN_START}model\n" if add_generation_prompt else ""),
    )
    alternate = F.forall(fine, lambda x: x)
    ok = alternate & ~F.col("_holed")
    reason = F.when(F.col("_holed"), F.lit("a turn has no text")).when(~alternate, F.lit("roles do not alternate"))
    return gathered.select(conv, F.when(ok, prompt).alias("prompt"), ok.alias("ok"), reason.alias("reason"))
