"""Preference formatting of paired conversations.

Method: the longest common turn prefix of the chosen and the rejected
conversation is rendered once, as the prompt; what follows it in either is
rendered as a masked completion, a list of segments (text, loss) in which only
the bodies of assistant turns carry loss.

Only DataFrame operations run: the prefix is the position of the first unequal
turn, and rendering is a transform over the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import materialize

TURN = "struct<role:string,text:string>"
TURNS = f"array<{TURN}>"
SEGMENTS = "array<struct<text:string,loss:boolean>>"
#: Chat template: what stands before and after a turn's text.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    before, after = OPEN.split("{role}")
    return F.concat(F.lit(before), F.coalesce(turn["role"], F.lit("")), F.lit(after))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns; null roles and texts equal each other."""
    short = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), short), lambda t: t["a"].eqNullSafe(t["b"]))
    first = F.array_position(same, False)
    return F.when(first == 0, short).otherwise(first - 1).cast("int")


def render(turns: Column) -> Column:
    """Turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def masked(turns: Column) -> Column:
    """Turns as segments (text, loss)."""
    seg = F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(_head(t).alias("text"), F.lit(False).alias("loss")),
        F.struct(_body(t).alias("text"), F.coalesce(t["role"] == TRAINED, F.lit(False)).alias("loss")))))
    return seg.cast(SEGMENTS)


def rest(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0)))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Add (n_prompt_turns, prompt, chosen_completion, rejected_completion) to ``pairs`` and drop the turns.

    ``chosen`` and ``rejected`` are arrays of turns (role, text).  Edge cases: a
    null array is empty; a null role or text renders as empty; equal
    conversations give two empty completions; an empty table gives no rows.
    The input row stands whole in ``row``, so its names can't clash.
    """
    empty = F.array().cast(TURNS)
    own = pairs.select(F.struct(*[F.col(f"`{c}`") for c in pairs.columns if c not in (chosen, rejected)]).alias("row"),
                       F.coalesce(F.col(chosen).cast(TURNS), empty).alias("c"), F.coalesce(F.col(rejected).cast(TURNS), empty).alias("r"))
    n = F.col("n_prompt_turns")
    return (own.withColumn("n_prompt_turns", common_turns(F.col("c"), F.col("r")))
            .select("row", "n_prompt_turns", render(F.slice("c", F.lit(1), n)).alias("prompt"),
                    masked(rest(F.col("c"), n)).alias("chosen_completion"), masked(rest(F.col("r"), n)).alias("rejected_completion")))


def preference_pairs(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One pair per conversation, from a table of turns.

    Conversations that open with the same turn answer the same request: the
    smallest id of them is chosen and each other is rejected against it (no pairs
    among the others).  The smallest itself, and a conversation that opens like
    no other, is chosen over its stale variant: the last assistant turn repeats
    the assistant turn before it (or is empty, if it is the only one); without
    an assistant turn the variant lacks the last turn.

    Turns are ordered by number, then role and text; repeated rows count once;
    rows with a null id are left out.  Returns (conv_id, chosen_id, rejected_id
    (null for a variant), chosen, rejected).
    """
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).filter("conv_id is not null")
    whole = (rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("t"))
             .select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).cast(TURNS).alias("turns")))
    whole = materialize(whole.withColumn("opening", F.xxhash64(F.element_at("turns", 1))), "chat_turns")
    first = materialize(whole.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("n"))
                        .filter("n > 1").select("opening", "chosen_id"), "chat_first")
    paired = whole.join(first, "opening").filter("conv_id <> chosen_id")
    chosen = whole.join(first.select("chosen_id").distinct(), F.col("conv_id") == F.col("chosen_id"), "left_semi")
    chosen = materialize(chosen.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chat_chosen")
    others = paired.join(chosen, "chosen_id").select("conv_id", "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))

    size = F.size("turns")
    said = F.filter(F.sequence(F.lit(1), size), lambda i: F.element_at("turns", i)["role"] == TRAINED)
    last, before = F.try_element_at(said, F.lit(-1)), F.try_element_at(said, F.lit(-2))
    stale = F.struct(F.lit(TRAINED).alias("role"), F.coalesce(F.try_element_at("turns", before)["text"], F.lit("")).alias("text")).cast(TURN)
    variant = F.when(last.isNull(), F.slice("turns", F.lit(1), size - 1)).otherwise(
        F.concat(F.slice("turns", F.lit(1), last - 1), F.array(stale), F.slice("turns", last + 1, size - last)))
    alone = whole.join(first, "opening", "left").filter("chosen_id is null or conv_id = chosen_id")
    alone = alone.select("conv_id", F.col("conv_id").alias("chosen_id"), F.lit(None).cast("long").alias("rejected_id"),
                         F.col("turns").alias("chosen"), variant.alias("rejected"))
    return others.unionByName(alone)
