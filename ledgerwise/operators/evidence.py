"""Profiles, wallet meta, evidence rows and activity selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions.common import DAY, LAMPORTS_PER_SOL, both_ends, newest_n
from ledgerwise.sources.tables import valid_address


def wallet_profile(transfers: DataFrame, meta: DataFrame, previous: DataFrame) -> DataFrame:
    """Earliest and latest sighting over meta, transfers and the previous profile."""
    seen = transfers.groupBy("wallet").agg(F.min("ts").alias("a1"), F.max("ts").alias("b1"))
    m = meta.select("wallet", F.col("first_tx_ts").alias("a2"), F.col("last_tx_ts").alias("b2"))
    p = previous.select("wallet", F.col("first_seen_at").alias("a3"), F.col("last_seen_at").alias("b3"))
    return seen.join(m, "wallet", "full").join(p, "wallet", "full").select(
        "wallet", F.least("a1", "a2", "a3").alias("first_seen_at"), F.greatest("b1", "b2", "b3").alias("last_seen_at"))


def wallet_meta(transfers: DataFrame, previous: DataFrame, as_of: int, scam_tx: DataFrame | None = None) -> DataFrame:
    """First and last transfer of wallets that have new activity; unchanged wallets are skipped."""
    seen = both_ends(transfers, "ts").filter("ts IS NOT NULL").groupBy("wallet").agg(
        F.min("ts").alias("first_tx_ts"), F.max("ts").alias("last_tx_ts"))
    fresh = seen.join(previous.select("wallet", "last_tx_ts"), ["wallet", "last_tx_ts"], "left_anti")
    if scam_tx is None:
        out = fresh.withColumn("_scam_ts", F.lit(None).cast("bigint"))
    else:
        out = fresh.join(scam_tx.groupBy("wallet").agg(F.max("ts").alias("_scam_ts")), "wallet", "left")
    days = lambda c: F.greatest(F.lit(0), F.floor((F.lit(as_of) - F.col(c)) / DAY))
    return out.select("wallet", "first_tx_ts", "last_tx_ts", days("first_tx_ts").alias("wallet_age_days"),
                      F.when(F.col("_scam_ts").isNull(), 9999).otherwise(days("_scam_ts")).alias("last_scam_days"))


def evidence_scan(transfers: DataFrame, scam: DataFrame, as_of: int, n: int | None = None, low_tx: int = 5,
                  new_days: int = 3, high_sol: float = 100.0) -> DataFrame:
    """Evidence rows of each wallet's transfers, or of its newest ``n``."""
    ends = both_ends(transfers, "signature", "ts", "amount_lamports")
    recent = ends if n is None else newest_n(
        ends, ["wallet"], [F.coalesce("ts", F.lit(0)).desc(), F.col("signature").desc()], n)
    order = F.struct(F.coalesce("ts", F.lit(0)), "signature")
    summary = recent.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"),
        F.min_by("signature", order).alias("last_sig"), F.max_by("signature", order).alias("newest_sig"),
        F.min_by("ts", order).alias("last_ts"),
    )
    none = F.lit(None)
    low = summary.filter(F.col("n") < low_tx).select(
        "wallet", F.lit("LOW_ACTIVITY").alias("reason_code"), F.col("last_sig").alias("tx_signature"),
        none.cast("string").alias("counterparty"), none.cast("bigint").alias("amount"),
        F.coalesce("last_ts", F.lit(as_of)).alias("timestamp"))
    new = summary.filter(F.lit(as_of) - F.col("oldest") < new_days * DAY).select(
        "wallet", F.lit("NEW_WALLET").alias("reason_code"), F.col("newest_sig").alias("tx_signature"),
        none.cast("string").alias("counterparty"), none.cast("bigint").alias("amount"),
        F.col("oldest").alias("timestamp"))
    moves = recent.filter("counterparty <> wallet")
    bad = scam.select(F.col("wallet").alias("counterparty")).distinct()
    cols = lambda code: ["wallet", F.lit(code).alias("reason_code"), F.col("signature").alias("tx_signature"),
                         "counterparty", F.col("amount_lamports").alias("amount"),
                         F.coalesce("ts", F.lit(as_of)).alias("timestamp")]
    drain = moves.join(bad, "counterparty", "left_semi").select(*cols("DRAINER_INTERACTION"))
    high = moves.filter(F.col("is_sender") & (F.col("amount_lamports") >= int(high_sol * LAMPORTS_PER_SOL))).select(
        *cols("HIGH_VALUE_OUTFLOW"))
    rows = low.unionByName(new).unionByName(drain).unionByName(high)
    return rows.dropDuplicates(["wallet", "reason_code", "tx_signature", "counterparty"])


def activity_stats(transfers: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """(wallet, tx_count, first_seen, last_seen) inside the window; mergeable with ``merge_stats``."""
    return both_ends(transfers, "ts").filter(F.col("ts") >= as_of - days * DAY).groupBy("wallet").agg(
        F.count(F.lit(1)).alias("tx_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def merge_stats(*parts: DataFrame) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("wallet").agg(F.sum("tx_count").alias("tx_count"), F.min("first_seen").alias("first_seen"),
                                      F.max("last_seen").alias("last_seen"))


def active_wallets(transfers: DataFrame, as_of: int, days: int = 30, min_tx: int = 20, min_age: int = 7,
                   limit: int | None = None, check_address: bool = True) -> DataFrame:
    stats = activity_stats(transfers, as_of, days).filter(
        (F.col("tx_count") >= min_tx) & (F.floor((F.lit(as_of) - F.col("first_seen")) / DAY) >= min_age))
    if check_address:
        stats = stats.filter(valid_address(F.col("wallet")))
    return stats if limit is None else stats.orderBy(F.desc("tx_count"), "wallet").limit(limit)
