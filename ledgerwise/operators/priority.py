"""Scan and analysis priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import DAY, assemble, both_ends, clamp, in_set, rnd
from ledgerwise.operators.graph import adjacency

# fixed values: seed priorities
SEED_PRIORITY = {"SCAM": 100, "NEW_WALLET": 80, "CLUSTER_1HOP": 70, "CLUSTER_2HOP": 60, "ACTIVE": 50}
TIER_RANK = {"critical": 3, "watchlist": 2, "normal": 1}


def scan_priority(candidates: DataFrame, reasons: DataFrame, scores: DataFrame, members: DataFrame, scam: DataFrame,
                  transfers: DataFrame, scans: DataFrame, as_of: int, n: int | None = None) -> DataFrame:
    """Weighted factors per candidate; ``scans`` has wallet, last_scan_ts and optionally followers."""
    recent = reasons.filter(in_set(F.col("reason_code"), P.HIGH_RISK_CODES) & (
        F.col("created_at").isNull() | (F.col("created_at") >= as_of - 7 * DAY))).groupBy("wallet").agg(
        F.lit(True).alias("_sus"))
    bad_clusters = members.join(scam.select("wallet"), "wallet", "left_semi").select("cluster_id").distinct()
    in_bad = members.join(bad_clusters, "cluster_id", "left_semi").groupBy("wallet").agg(F.lit(True).alias("_clu"))
    counts = transfers.groupBy("wallet").agg(F.count(F.lit(1)).alias("_tx"))
    top = counts.agg(F.max("_tx").alias("m")).scalar()
    df = assemble(candidates.select("wallet").distinct(), recent, scores.select("wallet", "score", F.lit(True).alias("_has")),
                  in_bad, counts, scans.select("wallet", "last_scan_ts", F.lit(True).alias("_scanned")))
    has = lambda c: F.coalesce(c, F.lit(False))
    sus, clu, scanned, scored = (has(F.col(c)) for c in ("_sus", "_clu", "_scanned", "_has"))
    trust = F.when(scored, F.greatest(F.lit(0.0), 1 - F.coalesce("score", F.lit(50.0)) / 100)).otherwise(0.0)
    tx = F.coalesce("_tx", F.lit(0))
    volume = F.coalesce(F.least(F.lit(1.0), F.try_divide(tx.cast("double"), top)), F.lit(0.0))
    days = F.when(F.coalesce("last_scan_ts", F.lit(0)) == 0, 30).otherwise(F.floor((F.lit(as_of) - F.col("last_scan_ts")) / DAY))
    since = F.when(scanned, F.least(F.lit(1.0), days / 30.0)).otherwise(1.0)
    total = (0.3 * sus.cast("double") + 0.2 * trust + 0.2 * clu.cast("double") + 0.1 * volume + 0.1 * since)
    reason = F.coalesce(
        F.when(sus, "recent_suspicious"), F.when(scored & (F.coalesce("score", F.lit(50.0)) < 40), "low_trust_score"),
        F.when(clu, "recent_scam_cluster"), F.when(tx > 100, "high_tx_volume"),
        F.when(scanned & (days > 7), "not_scanned_recently"), F.when(~scanned, "never_scanned"), F.lit("default"))
    out = df.select("wallet", clamp(total, 0.0, 1.0).alias("priority"), reason.alias("reason"))
    return out if n is None else out.orderBy(F.desc(F.round("priority", 9)), "wallet").limit(n)


def ordered_union(scam: DataFrame, meta: DataFrame, transfers: DataFrame, scans: DataFrame, as_of: int,
                  limit: int | None = None) -> DataFrame:
    """(wallet, rank): 1 scam, 2 new, 3 active, 4 stale; a wallet keeps its first list."""
    lists = [
        scam.select("wallet"), meta.filter(F.col("first_tx_ts") >= as_of - 7 * DAY).select("wallet"),
        transfers.filter(F.col("ts") >= as_of - DAY).select("wallet").distinct(),
        scans.filter(F.col("last_scan_ts") < as_of - 30 * DAY).select("wallet"),
    ]
    if limit is not None:
        lists = [df.orderBy("wallet").limit(limit) for df in lists]
    ranked = [df.withColumn("rank", F.lit(i)) for i, df in enumerate(lists, start=1)]
    return reduce(DataFrame.unionByName, ranked).groupBy("wallet").agg(F.min("rank").alias("rank"))


def _near_scam(edges: DataFrame, scam: DataFrame) -> DataFrame:
    """(wallet, hop) for wallets one or two hops from any scam wallet; linear in the edges."""
    adj = adjacency(edges)
    sources = scam.select("wallet").distinct()
    one = adj.join(sources, "wallet", "left_semi").select(F.col("neighbor").alias("wallet")).distinct()
    two = adj.join(one, "wallet", "left_semi").select(F.col("neighbor").alias("wallet")).distinct()
    both = one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))
    return both.groupBy("wallet").agg(F.min("hop").alias("hop"))


def seed_priorities(scam: DataFrame, edges: DataFrame, meta: DataFrame, transfers: DataFrame, existing: DataFrame | None,
                    as_of: int) -> DataFrame:
    """Highest priority per wallet; meta: wallet, wallet_age_days, first_tx_ts."""
    near = _near_scam(edges, scam)
    new = meta.filter((F.col("wallet_age_days") < 3) | (F.col("first_tx_ts") >= as_of - 3 * DAY)).select("wallet")
    active = both_ends(transfers, self_once=False).groupBy("wallet").count().filter("count > 50").select("wallet")
    row = lambda df, reason, hop: df.select(
        "wallet", F.lit(SEED_PRIORITY[reason]).alias("priority"), F.lit(reason).alias("reason"), F.lit(hop).alias("hop"))
    rows = [row(scam, "SCAM", 0), row(near.filter("hop = 1"), "CLUSTER_1HOP", 1), row(near.filter("hop = 2"), "CLUSTER_2HOP", 2),
            row(new, "NEW_WALLET", 0), row(active, "ACTIVE", 0)]
    if existing is not None:
        rows.append(existing.select("wallet", "priority", "reason", "hop"))
    all_rows = reduce(DataFrame.unionByName, rows)
    best = F.max_by(F.struct("priority", "reason", "hop"), F.struct("priority", "reason"))
    return all_rows.groupBy("wallet").agg(best.alias("b")).select("wallet", "b.*")


def age_priorities(priorities: DataFrame, as_of: int) -> DataFrame:
    days = F.greatest(F.lit(0), F.floor((F.lit(as_of) - F.col("last_checked")) / DAY))
    lower = F.col("priority") - 2 * days - F.when(days > 30, 20).otherwise(0)
    changed = F.when(F.col("last_checked").isNull(), F.col("priority")).otherwise(clamp(lower, 0, 100))
    return priorities.withColumn("priority", changed.cast("int"))


def boost_active(priorities: DataFrame, transfers: DataFrame, as_of: int) -> DataFrame:
    recent = both_ends(transfers, "ts").groupBy("wallet").agg(
        F.max("ts").alias("last_tx_time"), F.count_if(F.col("ts") > as_of - DAY).alias("tx_count_24h"))
    n = F.coalesce("tx_count_24h", F.lit(0))
    return priorities.join(recent, "wallet", "left").withColumns(
        {"priority": F.least(F.lit(100), F.col("priority") + 2 * n).cast("int"), "tx_count_24h": n})


def expire_priorities(priorities: DataFrame, as_of: int, days: int = 30, deltas: DataFrame | None = None) -> DataFrame:
    """Entries checked within ``days`` (or never), with optional (wallet, delta) changes added."""
    kept = priorities.filter(F.col("last_checked").isNull() | (F.col("last_checked") >= as_of - days * DAY))
    if deltas is None:
        return kept
    return kept.join(deltas.groupBy("wallet").agg(F.sum("delta").alias("_d")), "wallet", "left").withColumn(
        "priority", clamp(F.col("priority") + F.coalesce("_d", F.lit(0)), 0, 100).cast("int")).drop("_d")


def select_with_budget(priorities: DataFrame, limit: int = 100, budget: int = 200) -> DataFrame:
    return priorities.orderBy(F.desc("priority"), F.asc_nulls_first("last_checked"), "wallet").limit(
        min(limit, budget)).select("wallet")


def tiered_batch(tracked: DataFrame, latest: DataFrame, profiles: DataFrame, as_of: int, limit: int,
                 high_below: float = 40.0, new_days: int = 7) -> DataFrame:
    """tracked: wallet, tier; latest: wallet, score, computed_at, is_anomalous, max_severity; profiles: wallet, first_seen_at."""
    df = assemble(tracked.select("wallet", "tier"),
                  latest.select("wallet", "score", "computed_at", "is_anomalous", "max_severity", F.lit(True).alias("_has")),
                  profiles.select("wallet", "first_seen_at"))
    s, sev = F.col("score"), F.col("max_severity")
    rule = lambda value, name: F.struct(value.cast("double").alias("p"), F.lit(name).alias("r"))
    picked = (
        F.when(sev.isin("critical", "high"), rule(1100 - F.coalesce(s, F.lit(0.0)), "escalation_severe_anomaly"))
        .when(s < high_below, rule(800 + (high_below - s), "high_risk_low_score"))
        .when(F.col("is_anomalous") & sev.isNotNull(), rule(F.lit(600), "recent_anomaly"))
        .when(F.col("_has").isNull(), rule(F.lit(500), "new_no_score"))
        .when(F.lit(as_of) - F.col("first_seen_at") <= new_days * DAY, rule(F.lit(499), "new_recent_first_seen"))
        .otherwise(rule(300 - F.least(F.lit(100.0), F.coalesce(s, F.lit(100.0))), "normal")))
    rank = F.when(F.col("tier") == "critical", 3).when(F.col("tier") == "watchlist", 2).otherwise(1)
    out = df.withColumns({"_p": picked, "_rank": rank})
    return out.orderBy(F.desc("_rank"), F.desc("_p.p"), F.coalesce("computed_at", F.lit(0)), "wallet").limit(limit).select(
        "wallet", "tier", F.col("_p.p").alias("priority"), F.col("_p.r").alias("reason"))


def cycle_selection(tracked: DataFrame, cycle: int, as_of: int, watchlist_every: int = 2, normal_every: int = 4,
                    interval_s: int = 30, limit: int | None = None) -> DataFrame:
    """tracked: wallet, tier, last_analyzed_at."""
    tier = F.lower(F.coalesce("tier", F.lit("normal")))
    elapsed = F.when(F.coalesce("last_analyzed_at", F.lit(0)) == 0, 999_999).otherwise(F.lit(as_of) - F.col("last_analyzed_at"))
    rank = F.when(tier == "critical", 1).when(tier == "watchlist", 2).otherwise(3)
    due = (
        ((rank == 1) & (elapsed >= 0))
        | ((rank == 2) & F.lit(cycle % watchlist_every == 0) & (elapsed >= watchlist_every * interval_s))
        | ((rank == 3) & F.lit(cycle % normal_every == 0) & (elapsed >= normal_every * interval_s)))
    out = tracked.filter(due).select("wallet", tier.alias("tier"), rank.alias("_rank"))
    if limit is not None:
        out = out.orderBy("_rank", "wallet").limit(limit)
    return out.drop("_rank")
