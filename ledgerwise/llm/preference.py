"""Preference formatting in DataFrame operations: one prompt, two masked completions.

The longest common turn prefix of the chosen and the rejected conversation (equal role and text, turn by turn) is
rendered once as the prompt.  What follows in each is its completion; its mask gives the character ranges to train on:
texts of ``TRAINED`` roles with their closing mark.  Marks are a template; character offsets count from the start of the
completion, ends are exclusive.

Results: one row per pair.  Null roles and texts count as empty.  Equal conversations have empty completions; if one
is the start of the other, its completion is empty.  An empty or null conversation has no common turn.  Turns with
equal numbers are ordered by role, then text, and repeated rows stay.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwise.functions.storage import cut_lineage

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = ("assistant",)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns) with the turns of each conversation in order."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Character ranges of the trained turns in the rendered ``turns``: one running sum over the turns."""
    head = lambda t: F.lit(len(OPEN) + len(MIDDLE)) + F.char_length(t["role"])
    body = lambda t: F.char_length(t["text"]) + F.lit(len(CLOSE))
    spans = F.array().cast("array<struct<start:int,end:int>>")

    def add(s: Column, t: Column) -> Column:
        start = s["at"] + head(t)
        span = F.array(F.struct(start.alias("start"), (start + body(t)).alias("end")))
        return F.struct((start + body(t)).alias("at"),
                        F.when(t["role"].isin(*TRAINED), F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), spans.alias("spans")), add, lambda s: s["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` (arrays of turns) with n_common, prompt, and text and mask of both completions."""
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    kept = [c for c in pairs.columns if c not in (chosen, rejected, "_c", "_r")]  # working names
    rows = pairs.select(*kept, F.coalesce(F.col(chosen), none).alias("_c"), F.coalesce(F.col(rejected), none).alias("_r"))
    differs = F.transform(F.col("_c"), lambda t, i: F.coalesce(
        (t["role"] != F.get(F.col("_r"), i)["role"]) | (t["text"] != F.get(F.col("_r"), i)["text"]), F.lit(True)))
    first = F.array_position(differs, True).cast("int")
    rows = rows.withColumn("n_common", F.when(first > 0, first - 1).otherwise(F.size("_c")))
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    return rows.select(
        *kept, "n_common", _render(F.slice("_c", 1, F.col("n_common"))).alias("prompt"),
        _render(rest("_c")).alias("chosen_completion"), _let(rest("_c"), _mask).alias("chosen_mask"),
        _render(rest("_r")).alias("rejected_completion"), _let(rest("_r"), _mask).alias("rejected_mask"))


def pairs_by_first_turn(convs: DataFrame) -> DataFrame:
    """Pairs of conversations with the same first turn: the smallest conv_id is the chosen one of all others.

    A first turn that many conversations share gives one pair for each, not all pairs among them."""
    keyed = cut_lineage(convs.withColumn("_first", F.sha2(F.concat_ws("\x00", F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256)))
    heads = cut_lineage(keyed.groupBy("_first").agg(F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    tails = keyed.join(heads, "_first").filter("conv_id <> chosen_id").select(
        "chosen_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))
    return tails.join(keyed.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id")


def pairs_with_foreign_reply(convs: DataFrame) -> DataFrame:
    """Pairs of each conversation that has a reply (a turn of a ``TRAINED`` role) with itself up to its last reply,
    which is replaced by the last reply of the next conversation by id that has one (the first one's, for the last).

    Ids may have gaps.  The conversations are range-partitioned by id: the next reply lies in the same partition or is
    the first one of the next partition, so only one row per partition meets others.
    """
    at = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"].isin(*TRAINED), i + 1)))
    rows = convs.select("conv_id", "turns", at.alias("_at")).filter("_at IS NOT NULL")
    spread = cut_lineage(rows.repartitionByRange("conv_id").withColumn("_p", F.spark_partition_id()))
    reply = F.struct("conv_id", F.col("turns")[F.col("_at") - 1].alias("turn"))
    here = spread.withColumn("_next", F.lead(reply).over(Window.partitionBy("_p").orderBy("conv_id")))
    heads = spread.groupBy("_p").agg(F.min_by(reply, "conv_id").alias("head"))  # one row per partition
    first = F.first("head").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("_p", F.coalesce(F.lead("head").over(Window.orderBy("_p")), first).alias("_after"))
    joined = here.join(after, "_p").withColumn("_other", F.coalesce("_next", "_after"))
    swapped = F.concat(F.slice("turns", 1, F.col("_at") - 1), F.array(F.col("_other")["turn"]))
    return joined.select(F.col("conv_id").alias("chosen_id"), F.col("_other")["conv_id"].alias("rejected_id"),
                         F.slice("turns", 1, F.col("_at")).alias("chosen"), swapped.alias("rejected"))
