"""Drainer heuristics.  Input ``records``: wallet, signature, ts, slot, program_id, approval_like,
has_swap, is_sender (outgoing), counterparty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwise.functions.common import assemble, near_in_time, ratio, rnd, split_rank
from ledgerwise.functions.storage import by_wallet, cut_lineage

TIME_BUCKET = 3_600
SLOT_BUCKET = 10_000


def _counted(df: DataFrame, flag: str, name: str) -> DataFrame:
    return df.groupBy("wallet").agg(F.count_if(flag).alias(name))


def approval_like_count(records: DataFrame, window_s: int = 30) -> DataFrame:
    approvals = records.filter("approval_like AND ts IS NOT NULL").select("wallet", "ts")
    near = near_in_time(approvals, "wallet", "ts", window_s, window_s, TIME_BUCKET, "_near", strict=True)
    return _counted(near, "_near", "approval_like_count")


def rapid_outflow_count(records: DataFrame, window_s: int = 60) -> DataFrame:
    out = records.filter("is_sender AND counterparty IS NOT NULL AND ts IS NOT NULL").select("wallet", "ts")
    near = near_in_time(out, "wallet", "ts", 0, window_s, TIME_BUCKET, "_near")
    return _counted(near, "_near", "rapid_outflow_count")


def multi_victim_pattern(records: DataFrame, min_senders: int = 3, max_receivers: int = 2) -> DataFrame:
    sides = records.select("wallet", "counterparty", "is_sender").distinct().groupBy("wallet").agg(
        F.count(F.when(~F.col("is_sender"), F.col("counterparty"))).alias("_senders"),
        F.count(F.when(F.col("is_sender"), F.col("counterparty"))).alias("_receivers"),
    )
    hit = (F.col("_senders") >= min_senders) & (F.col("_receivers") <= max_receivers)
    return sides.select("wallet", hit.cast("int").alias("multi_victim_pattern"))


def new_program_count(records: DataFrame) -> DataFrame:
    """Programs first used in the second half of the wallet's records (slot order)."""
    known = records.filter("slot IS NOT NULL").select("wallet", "slot", "signature", "program_id")
    ranked = split_rank(known, ["wallet"], F.floor(F.col("slot") / SLOT_BUCKET),
                        [F.col("slot"), F.col("signature")])
    first_use = ranked.groupBy("wallet", "program_id").agg(
        F.min("rank").alias("first_rank"), F.max("total").alias("total")
    )
    late = (F.col("total") >= 2) & (F.col("first_rank") > F.floor(F.col("total") / 2))
    return first_use.groupBy("wallet").agg(
        F.count_if(late & F.col("program_id").isNotNull()).alias("new_contract_interaction_count")
    )


def swap_then_transfer(records: DataFrame, slot_delta: int = 2) -> DataFrame:
    """Swaps followed within the next three rows and ``slot_delta`` slots by an outgoing transfer.

    Only rows at most ``slot_delta`` slots later matter, so each row is placed in its
    slot bucket and, near the edge, in the previous one; the look-ahead stays inside a bucket.
    """
    rows = records.filter("slot IS NOT NULL").select(
        "wallet", "slot", "signature", "has_swap", (F.col("is_sender") & F.col("counterparty").isNotNull()).alias("_sends"))
    home = F.floor(F.col("slot") / SLOT_BUCKET)
    early = F.floor((F.col("slot") - slot_delta) / SLOT_BUCKET)
    spread = rows.withColumn("_home", home).withColumn("_bucket", F.explode(F.array_distinct(F.array(home, early))))
    w = Window.partitionBy("wallet", "_bucket").orderBy("slot", "signature")
    hits = F.lit(False)
    for step in range(1, slot_delta + 2):
        follows = (F.lead("slot", step).over(w) - F.col("slot") <= slot_delta) & F.lead("_sends", step).over(w)
        hits = hits | F.coalesce(follows, F.lit(False))
    marked = spread.withColumn("_hit", F.col("has_swap") & hits).filter(F.col("_home") == F.col("_bucket"))
    return _counted(marked, "_hit", "swap_then_transfer_pattern")


def percent_to_top_destination(records: DataFrame) -> DataFrame:
    per_dest = records.filter("is_sender AND counterparty IS NOT NULL").groupBy("wallet", "counterparty").count()
    return per_dest.groupBy("wallet").agg(
        rnd(100.0 * ratio(F.max("count"), F.sum("count")), 2).alias("percent_to_same_cluster")
    )


def _by_time(records: DataFrame, window_s: int = 30, outflow_s: int = 60) -> DataFrame:
    """``approval_like_count`` and ``rapid_outflow_count`` of wallets that one task holds: one order serves both."""
    sends = F.coalesce(F.col("is_sender") & F.col("counterparty").isNotNull(), F.lit(False))
    rows = records.filter("ts IS NOT NULL").select(
        "wallet", "ts", F.coalesce("approval_like", F.lit(False)).alias("_asks"), sends.alias("_sends")).filter("_asks OR _sends")
    w = Window.partitionBy("wallet").orderBy("ts")
    asked, sent = F.count_if("_asks"), F.count_if("_sends")
    marked = rows.withColumns({
        "_near": F.col("_asks") & (asked.over(w.rangeBetween(-window_s, window_s)) > asked.over(w.rangeBetween(0, 0))),
        "_rapid": F.col("_sends") & (sent.over(w.rangeBetween(0, outflow_s)) > 1)})
    return marked.groupBy("wallet").agg(
        F.count_if("_near").alias("approval_like_count"), F.count_if("_rapid").alias("rapid_outflow_count"))


def _by_pair(records: DataFrame, min_senders: int = 3, max_receivers: int = 2) -> DataFrame:
    """``multi_victim_pattern`` and ``percent_to_same_cluster`` from one row per (wallet, counterparty)."""
    pairs = records.groupBy("wallet", "counterparty").agg(
        F.count_if("is_sender").alias("_sent"), F.count_if(~F.col("is_sender")).alias("_got"))
    named = F.col("counterparty").isNotNull()
    sent = F.when(named, F.col("_sent"))
    hit = (F.count_if(named & (F.col("_got") > 0)) >= min_senders) & (F.count_if(named & (F.col("_sent") > 0)) <= max_receivers)
    return pairs.groupBy("wallet").agg(
        hit.cast("int").alias("multi_victim_pattern"), rnd(100.0 * ratio(F.max(sent), F.sum(sent)), 2).alias("percent_to_same_cluster"))


def _by_slot(records: DataFrame, slot_delta: int = 2) -> DataFrame:
    """``new_contract_interaction_count`` and ``swap_then_transfer_pattern`` of wallets that one task holds: one order serves both."""
    rows = records.filter("slot IS NOT NULL").select(
        "wallet", "slot", "signature", "program_id", "has_swap", (F.col("is_sender") & F.col("counterparty").isNotNull()).alias("_sends"))
    w = Window.partitionBy("wallet").orderBy("slot", "signature")
    hits = F.lit(False)
    for step in range(1, slot_delta + 2):
        follows = (F.lead("slot", step).over(w) - F.col("slot") <= slot_delta) & F.lead("_sends", step).over(w)
        hits = hits | F.coalesce(follows, F.lit(False))
    programs = rows.withColumns({"_rank": F.row_number().over(w), "_hit": F.col("has_swap") & hits}).groupBy("wallet", "program_id").agg(
        F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count_if("_hit").alias("_hits"))
    total = F.col("_total")
    late = (total >= 2) & (F.col("_first") > F.floor(total / 2)) & F.col("program_id").isNotNull()
    return programs.withColumn("_total", F.sum("_n").over(Window.partitionBy("wallet"))).groupBy("wallet").agg(
        F.count_if(late).alias("new_contract_interaction_count"), F.sum("_hits").alias("swap_then_transfer_pattern"))


RECORD = ("wallet", "signature", "ts", "slot", "program_id", "approval_like", "has_swap", "is_sender", "counterparty")


def drainer_features(records: DataFrame, wallets: DataFrame, split: list[tuple[DataFrame, bool]] | None = None) -> DataFrame:
    """All heuristics side by side.  ``split``: the records, dealt out by ``by_wallet``.

    Heuristics of ordinary wallets that share an order or a grouping share a pass.  Each part is written before the next is
    computed, so only one holds shuffle files at a time.
    """
    if split is None:
        with by_wallet(records.select(*RECORD)) as split:
            return drainer_features(records, wallets, split)
    spread = (approval_like_count, rapid_outflow_count, multi_victim_pattern, new_program_count, swap_then_transfer,
              percent_to_top_destination)
    parts = [cut_lineage(part(rows)) for rows, hot in split for part in (spread if hot else (_by_time, _by_pair, _by_slot))]
    return assemble(wallets.select("wallet").distinct(), *parts).fillna(0).select(
        "wallet", "approval_like_count", "rapid_outflow_count", "multi_victim_pattern", "new_contract_interaction_count",
        "swap_then_transfer_pattern", "percent_to_same_cluster")
