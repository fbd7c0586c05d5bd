"""Wallet report tables: the read queries, for all wallets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import (
    DAY, LAMPORTS_PER_SOL, assemble, both_ends, codes, in_set, lookup, newest_n, ratio, rnd, title_case, utc_date,
    utc_minute_text,
)
from ledgerwise.functions.scores import badge, recommended_actions, risk_level
from ledgerwise.functions.storage import cut_lineage
from ledgerwise.operators.features import wallet_pairs
from ledgerwise.operators.graph import cluster_scam_ratio, flow_to_scam, suspicious_tx_count
from ledgerwise.operators.timeseries import score_change_30d

_NONE = lambda: F.array().cast("array<string>")


def _clusters(members: DataFrame) -> DataFrame:
    """(wallet, cluster_id, cluster_size), the smallest cluster id when a wallet is in several."""
    m = members.select("wallet", "cluster_id").distinct()
    sizes = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return m.groupBy("wallet").agg(F.min("cluster_id").alias("cluster_id")).join(sizes, "cluster_id")


def identity_profile(scores: DataFrame, members: DataFrame, transfers: DataFrame, reasons: DataFrame) -> DataFrame:
    pairs = wallet_pairs(transfers).groupBy("wallet").agg(
        F.count_if(F.col("counterparty").isNotNull()).alias("degree"), F.sum("tx_count").alias("total_transactions"),
        F.sum("lamports").alias("volume_lamports"))
    by_reason = reasons.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("reason_count"),
        F.max_by("reason_code", F.struct("created_at", "tx_hash")).alias("latest_reason"))
    wallets = scores.select("wallet").union(pairs.select("wallet")).distinct()
    df = assemble(wallets, scores.select("wallet", "score"), _clusters(members), pairs, by_reason).fillna(
        0, ["cluster_size", "degree", "total_transactions", "volume_lamports", "reason_count"])
    score = F.coalesce("score", F.lit(50.0))
    level = F.when(score >= 80, "LOW").when(score >= 50, "MEDIUM").otherwise("HIGH")
    return df.select("wallet", score.alias("trust_score"), level.alias("risk_level"), "cluster_id", "cluster_size", "degree",
                     "total_transactions", "volume_lamports", "reason_count", "latest_reason")


def identity_activity(transfers: DataFrame) -> DataFrame:
    return both_ends(transfers, "ts").groupBy("wallet").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("total_transactions"))


def counterparties(transfers: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, summary).  Transfers are aggregated per (wallet, counterparty) before scores are joined."""
    ends = both_ends(transfers, "amount_lamports", self_once=False).filter("counterparty IS NOT NULL")
    pairs = ends.groupBy("wallet", "counterparty").agg(
        F.count_if(~F.col("is_sender")).alias("inbound_tx"), F.count_if("is_sender").alias("outbound_tx"),
        F.count(F.lit(1)).alias("total_tx"), F.coalesce(F.sum("amount_lamports"), F.lit(0)).alias("total_volume_lamports"))
    pairs = pairs.join(scores.select(F.col("wallet").alias("counterparty"), "score"), "counterparty", "left")
    score = F.coalesce("score", F.lit(0.0))
    level = F.when(score >= 80, "LOW").when(score >= 50, "MEDIUM").otherwise("HIGH")
    pairs = pairs.select("wallet", "counterparty", "inbound_tx", "outbound_tx", "total_tx", "total_volume_lamports",
                         score.alias("trust_score"), level.alias("risk_level"))
    return pairs, exposure_summary(pairs)


def exposure_summary(pairs: DataFrame) -> DataFrame:
    risky = F.count_if(F.col("trust_score") < 50)
    return pairs.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("total_counterparties"), risky.alias("high_risk_counterparties"),
        rnd(ratio(risky, F.count(F.lit(1))), 4).alias("exposure_ratio"))


def graph_summary(transfers: DataFrame, scores: DataFrame, members: DataFrame) -> DataFrame:
    ends = both_ends(transfers, "amount_lamports", self_once=False)
    pairs = ends.groupBy("wallet", "counterparty").agg(
        F.count_if(~F.col("is_sender")).alias("i"), F.count_if("is_sender").alias("o"),
        F.sum(F.when(~F.col("is_sender"), F.col("amount_lamports"))).alias("iv"),
        F.sum(F.when(F.col("is_sender"), F.col("amount_lamports"))).alias("ov"))
    low = scores.filter("score < 50").select(F.col("wallet").alias("counterparty"), F.lit(1).alias("_low"))
    per_wallet = pairs.join(low, "counterparty", "left").groupBy("wallet").agg(
        F.sum("i").alias("inbound"), F.sum("o").alias("outbound"), F.coalesce(F.sum("iv"), F.lit(0)).alias("inbound_lamports"),
        F.coalesce(F.sum("ov"), F.lit(0)).alias("outbound_lamports"), F.count("counterparty").alias("unique_counterparties"),
        F.count("_low").alias("high_risk_neighbors"))
    c = _clusters(members)
    density = c.join(scores.select("wallet", "score"), "wallet", "left").groupBy("cluster_id").agg(
        rnd(ratio(F.count_if(F.col("score") < 50), F.count(F.lit(1))), 4).alias("cluster_risk_density"))
    return assemble(per_wallet, c.join(density, "cluster_id")).fillna(0, ["cluster_size", "cluster_risk_density"])


def propagation_preview(pairs: DataFrame) -> DataFrame:
    raw = F.sum(((100 - F.col("trust_score")) * F.col("total_tx")).cast("decimal(28,6)")).cast("double")
    g = pairs.groupBy("wallet").agg(F.count(F.lit(1)).alias("total_neighbors"),
                                    F.sum("total_tx").alias("total_transactions"), raw.alias("raw_impact"))
    impact = F.coalesce(rnd(ratio(F.col("raw_impact"), F.col("total_transactions")), 2), F.lit(0.0))
    g = g.withColumn("normalized_impact", impact)
    n = F.col("normalized_impact")
    return g.withColumn("risk_signal", F.when(n >= 70, "HIGH").when(n >= 40, "MEDIUM").otherwise("LOW"))


def _category(score: Column, exposure: Column) -> Column:
    return (
        F.when((score <= 30) & (exposure >= 0.5), "TOXIC_NODE").when((score <= 30) & (exposure == 0), "SELF_RISK")
        .when((score > 30) & (exposure >= 0.5), "NETWORK_EXPOSED").when((exposure > 0) & (score >= 50), "MONITORED")
        .when((score >= 60) & (exposure == 0), "CLEAN").otherwise("NEUTRAL"))


def _confidence(category: Column) -> Column:
    return (F.when(category.isin("TOXIC_NODE", "SELF_RISK"), "HIGH")
            .when(category.isin("NETWORK_EXPOSED", "MONITORED"), "MEDIUM").otherwise("LOW"))


def wallet_category(scores: DataFrame, summary: DataFrame) -> DataFrame:
    wallets = scores.select("wallet").union(summary.select("wallet")).distinct()
    df = assemble(wallets, scores.select("wallet", "score"), summary.select("wallet", "exposure_ratio"))
    cat = _category(F.coalesce("score", F.lit(50.0)), F.coalesce("exposure_ratio", F.lit(0.0)))
    return df.select("wallet", cat.alias("category")).withColumn("confidence", _confidence(F.col("category")))


def _flags(score: Column, cluster_id: Column, size: Column, tx: Column, exposure: Column, impact: Column) -> Column:
    return codes(
        (tx == 0, "ISOLATED"), (cluster_id.isNotNull() & (size > 1), "CLUSTERED"), (exposure > 0, "EXPOSED"),
        ((exposure >= 0.5) | (impact >= 70), "CONTAMINATED"), (score < 50, "HIGH_RISK_SELF"))


def wallet_flags(profile: DataFrame, summary: DataFrame, preview: DataFrame) -> DataFrame:
    df = assemble(profile.select("wallet", "trust_score", "cluster_id", "cluster_size", "total_transactions"),
                  summary.select("wallet", "exposure_ratio"), preview.select("wallet", "normalized_impact")).fillna(
        0, ["exposure_ratio", "normalized_impact"])
    c = F.col
    return df.select("wallet", _flags(c("trust_score"), c("cluster_id"), c("cluster_size"), c("total_transactions"),
                                      c("exposure_ratio"), c("normalized_impact")).alias("flags"))


def summary_compact(scores: DataFrame, members: DataFrame, transfers: DataFrame, reasons: DataFrame) -> DataFrame:
    """scores: wallet, score, computed_at."""
    profile = identity_profile(scores, members, transfers, reasons)
    pairs, summary = counterparties(transfers, scores)
    worst = reasons.filter("weight < 0").groupBy("wallet").agg(
        F.min_by(F.struct(F.col("reason_code").alias("code"), "weight"), F.struct("weight", "reason_code")).alias("primary_risk_driver"))
    df = assemble(
        profile.select("wallet", "trust_score", "cluster_id", "cluster_size", "total_transactions"),
        summary.select("wallet", "exposure_ratio"),
        propagation_preview(pairs).select("wallet", "normalized_impact", F.col("risk_signal").alias("propagation_signal")),
        worst, scores.select("wallet", F.col("computed_at").alias("last_updated")),
    ).fillna(0, ["exposure_ratio", "normalized_impact"]).fillna("LOW", ["propagation_signal"])
    s, x = F.col("trust_score"), F.col("exposure_ratio")
    df = df.withColumns({
        "intrinsic_risk_level": F.when(s <= 30, "HIGH").when(s < 60, "MEDIUM").otherwise("LOW"),
        "contextual_risk_level": F.when(x >= 0.5, "HIGH").when(x > 0, "MEDIUM").otherwise("LOW"),
        "category": _category(s, x),
        "badges": _flags(s, F.col("cluster_id"), F.col("cluster_size"), F.col("total_transactions"), x, F.col("normalized_impact")),
    })
    risky, review = F.col("intrinsic_risk_level") == "HIGH", F.col("contextual_risk_level") == "HIGH"
    pick = lambda a, b, c: F.when(risky, a).when(review, b).otherwise(c)
    return df.select(
        "wallet", s, "intrinsic_risk_level", "contextual_risk_level", pick("RISKY", "REVIEW", "SAFE").alias("simple_status"),
        pick("HIGH", "MEDIUM", "LOW").alias("risk_tier"), pick("RED", "AMBER", "GREEN").alias("risk_color"),
        pick("This wallet shows direct risk indicators.", "This wallet has exposure to higher-risk entities.",
             "No direct or network risk detected.").alias("summary_message"),
        "primary_risk_driver", "category", _confidence(F.col("category")).alias("confidence"), "cluster_id", "cluster_size",
        "exposure_ratio", "propagation_signal", "badges",
        recommended_actions(F.col("category"), F.col("intrinsic_risk_level"), F.col("contextual_risk_level"))
        .alias("recommended_actions"), "last_updated")


def top_neighbors(transfers: DataFrame, scores: DataFrame, n: int = 20) -> DataFrame:
    pairs = wallet_pairs(transfers).filter("counterparty IS NOT NULL AND counterparty <> wallet")
    top = newest_n(pairs, ["wallet"], [F.desc("tx_count"), F.col("counterparty")], n)
    return top.join(scores.select(F.col("wallet").alias("counterparty"), "score"), "counterparty", "left").select(
        "wallet", F.col("counterparty").alias("neighbor"), F.col("tx_count").alias("interactions"),
        F.coalesce("score", F.lit(50.0)).alias("risk_score"))


def _cluster_links(members: DataFrame, n: int) -> DataFrame:
    """(wallet, target): for each member the first ``n`` other members.

    Only the first n + 1 members of a cluster can be anyone's first n others, so a cluster of size k gives k * (n + 1) rows
    instead of all its pairs.
    """
    m = members.select("cluster_id", "wallet").distinct()
    head = newest_n(m, ["cluster_id"], [F.col("wallet")], n + 1).select("cluster_id", F.col("wallet").alias("target"))
    return m.join(head, "cluster_id").filter("wallet <> target").select("wallet", "target").distinct()


def _factors(transfers: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counterparties that share no cluster with the wallet: wallet, node; members of clusters with company: cluster_id, wallet).

    Together they stand for all pairs of a wallet with its counterparties and cluster members, in rows that are
    linear in the pairs of transfers and in the memberships.
    """
    m = members.select("cluster_id", "wallet").distinct()
    several = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("cluster_id")
    m = cut_lineage(m.join(several, "cluster_id"))
    pairs = wallet_pairs(transfers).filter("counterparty IS NOT NULL AND counterparty <> wallet").select(
        "wallet", F.col("counterparty").alias("node"))
    common = pairs.join(m, "wallet").join(m.withColumnRenamed("wallet", "node"), ["node", "cluster_id"]).select("wallet", "node").distinct()
    return pairs.join(common, ["wallet", "node"], "left_anti"), m


def _risk_mark(score: Column, risky_below: float) -> Column:
    return F.when(F.coalesce(score, F.lit(50.0)) < risky_below, "HIGH")


def flow_paths(transfers: DataFrame, members: DataFrame, scores: DataFrame, n: int | None = None,
               risky_below: float = 25) -> DataFrame:
    """Per wallet its cluster members and counterparties.

    Without ``n`` all of them, factorised, so that a cluster of k wallets takes 2k rows and not k * k: rows of
    relationship ``interaction`` (source, target, risk), ``cluster`` (source, cluster_id: all other members of that cluster)
    and ``member`` (cluster_id, target, risk).  ``paths_of`` unfolds them for chosen wallets.  With ``n`` the first ``n``
    targets of each wallet (members first, by name) as rows (source, target, relationship, risk).
    """
    s = scores.select(F.col("wallet").alias("target"), "score")
    risk = _risk_mark(F.col("score"), risky_below).alias("risk")
    if n is None:
        pairs, m = _factors(transfers, members)
        none = F.lit(None).cast("string")
        links = pairs.select(F.col("wallet").alias("source"), F.lit(None).cast(m.schema["cluster_id"].dataType).alias("cluster_id"),
                             F.col("node").alias("target"), F.lit("interaction").alias("relationship"))
        held = m.select(none.alias("source"), "cluster_id", F.col("wallet").alias("target"), F.lit("member").alias("relationship"))
        own = m.select(F.col("wallet").alias("source"), "cluster_id", none.alias("target"), F.lit("cluster").alias("relationship"))
        return links.unionByName(held).join(s, "target", "left").select("source", "cluster_id", "target", "relationship", risk).unionByName(
            own.withColumn("risk", none))
    pairs = wallet_pairs(transfers).filter("counterparty IS NOT NULL AND counterparty <> wallet").select(
        "wallet", F.col("counterparty").alias("target"), F.lit(2).alias("kind"))
    rows = _cluster_links(members, n).withColumn("kind", F.lit(1)).unionByName(pairs).groupBy("wallet", "target").agg(
        F.min("kind").alias("kind"))
    top = newest_n(rows, ["wallet"], [F.col("kind"), F.col("target")], n)
    return top.join(s, "target", "left").select(
        F.col("wallet").alias("source"), "target", F.when(F.col("kind") == 1, "cluster").otherwise("interaction").alias("relationship"), risk)


def paths_of(paths: DataFrame, wallets: DataFrame) -> DataFrame:
    """(source, target, relationship, risk) of chosen wallets, from factorised ``flow_paths``."""
    chosen = wallets.select(F.col("wallet").alias("source")).distinct()
    own = paths.filter("source IS NOT NULL").join(chosen, "source")
    held = paths.filter("relationship = 'member'").select("cluster_id", "target", "risk")
    inside = own.filter("relationship = 'cluster'").select("source", "cluster_id").join(held, "cluster_id").filter("source <> target")
    return own.filter("relationship = 'interaction'").select("source", "target", "relationship", "risk").unionByName(
        inside.select("source", "target", F.lit("cluster").alias("relationship"), "risk").distinct())


def identity_graph(transfers: DataFrame, members: DataFrame, scores: DataFrame, max_nodes: int | None = None,
                   max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per wallet: nodes (itself, counterparties, then cluster members, by name) and its undirected edges to them.

    Without limits all of them, factorised like ``flow_paths``: nodes (wallet, cluster_id, node, risk), where a row without
    a node stands for the members of the cluster, which are the rows without a wallet; edges (wallet, cluster_id,
    source, target), where a row without ends stands for the edges to all other members.  With limits the first
    ``max_nodes`` nodes (wallet, node, risk) and ``max_edges`` edges (wallet, source, target).
    """
    s = scores.select(F.col("wallet").alias("node"), "score")
    risk = F.coalesce("score", F.lit(50.0)).alias("risk")
    if max_nodes is None and max_edges is None:
        pairs, m = _factors(transfers, members)
        none, no_cluster = F.lit(None).cast("string"), F.lit(None).cast(m.schema["cluster_id"].dataType).alias("cluster_id")
        own = pairs.select("wallet").union(m.select("wallet")).distinct().select("wallet", F.col("wallet").alias("node"))
        alone = own.unionByName(pairs).select("wallet", no_cluster, "node")
        held = m.select(none.alias("wallet"), "cluster_id", F.col("wallet").alias("node"))
        inside = m.select("wallet", "cluster_id")
        nodes = alone.unionByName(held).join(s, "node", "left").select("wallet", "cluster_id", "node", risk).unionByName(
            inside.select("wallet", "cluster_id", none.alias("node"), F.lit(None).cast("double").alias("risk")))
        edges = pairs.select("wallet", no_cluster, F.least("wallet", "node").alias("source"), F.greatest("wallet", "node").alias("target"))
        return nodes, edges.unionByName(inside.select("wallet", "cluster_id", none.alias("source"), none.alias("target")))
    pairs = wallet_pairs(transfers).filter("counterparty IS NOT NULL AND counterparty <> wallet").select(
        "wallet", F.col("counterparty").alias("node"), F.lit(1).alias("kind"))
    limits = [x for x in (max_nodes, None if max_edges is None else max_edges + 1) if x is not None]
    links = _cluster_links(members, max(limits)).select("wallet", F.col("target").alias("node"), F.lit(2).alias("kind"))
    own = pairs.select("wallet").union(links.select("wallet")).distinct().select(
        "wallet", F.col("wallet").alias("node"), F.lit(0).alias("kind"))
    rows = own.unionByName(pairs).unionByName(links).groupBy("wallet", "node").agg(F.min("kind").alias("kind"))
    first = lambda n: newest_n(rows, ["wallet"], [F.col("kind"), F.col("node")], n)
    nodes = first(max_nodes if max_nodes is not None else max(limits)).join(s, "node", "left").select("wallet", "node", risk)
    edges = first(min(limits)).filter("kind > 0").select(
        "wallet", F.least("wallet", "node").alias("source"), F.greatest("wallet", "node").alias("target"))
    return nodes, edges


def _ordered_codes(top: DataFrame, value: Column, name: str) -> DataFrame:
    """Values of a ranked, bounded set per wallet, in rank order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", value.alias("v"))))
    return top.groupBy("wallet").agg(F.array_distinct(F.transform(listed, lambda e: e["v"])).alias(name))


def _newest_codes(rows: DataFrame, value: Column, name: str, at: str, tie: Column) -> DataFrame:
    """Distinct values of all rows per wallet, newest ``at`` first, then by descending ``tie``."""
    last = rows.groupBy("wallet", value.alias("v")).agg(F.max(F.struct(F.col(at).alias("at"), tie.alias("tie"))).alias("last"))
    listed = F.sort_array(F.collect_list(F.struct("last", "v")), asc=False)
    return last.groupBy("wallet").agg(F.transform(listed, lambda e: e["v"]).alias(name))


def wallet_overview(scores: DataFrame, reasons: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """scores: wallet, score, risk_level (may be blank); clusters: cluster_id, cluster_type, confidence."""
    recent = newest_n(reasons.filter("trim(reason_code) <> ''"), ["wallet"], [F.desc("created_at"), F.desc("tx_hash")], 5, rank="rank")
    code = F.trim("reason_code")
    patterns = _ordered_codes(recent, F.coalesce(lookup(P.PATTERN_LABELS, code), title_case(code)), "pattern")
    c = _clusters(members).join(clusters.select("cluster_id", "cluster_type", "confidence"), "cluster_id", "left")
    df = assemble(scores.select("wallet", F.coalesce("score", F.lit(0.0)).alias("score"), F.trim("risk_level").alias("_rl")), patterns,
                  c.withColumnRenamed("confidence", "cluster_confidence"))
    s = F.col("score")
    bands = lambda a, b, c_, d: F.when(s < 30, a).when(s < 50, b).when(s < 70, c_).otherwise(d)
    clustered = F.col("cluster_id").isNotNull()
    scam = F.coalesce(clustered & (F.col("cluster_type") == "scam"), F.lit(False))
    default = F.array(*[F.lit(t) for t in P.DEFAULT_PATTERN])
    pattern = F.coalesce("pattern", default)
    df = df.withColumn("behavioral_pattern", pattern)
    mentions = lambda *words: F.exists(
        "behavioral_pattern", lambda p: F.lower(p).rlike("|".join(words)))
    actions = codes(
        (scam, "Disconnect from all token approvals linked to this cluster."),
        (scam, F.concat(F.lit("Avoid interacting with wallets in Cluster #"), F.col("cluster_id").cast("string"), F.lit("."))),
        (mentions("cluster"), "Review recent counterparties for suspicious activity."),
        (mentions("cluster"), "Reassess cluster-related transaction patterns."),
        (mentions("new wallet"), "Monitor this new wallet closely before trusting it."),
        (mentions("low activity", "holder"), "Verify wallet identity before large transfers."),
        (mentions("dex"), "Review DEX transaction history for wash trading patterns."),
        (mentions("nft"), "Check NFT collection for known scam projects."),
        (mentions("clean"), "No immediate action required. Continue monitoring."),
        (s < 30, "Do NOT send funds to this wallet."), (s < 30, "Report wallet to Solana community watchlists."),
        ((s >= 30) & (s < 50), "Exercise caution before any interaction."))
    fallback = F.array(F.lit("Monitor wallet for unusual activity."), F.lit("Verify all recent transactions."))
    return df.select(
        "wallet", F.round(s).cast("int").alias("trust_score"),
        F.when(F.coalesce("_rl", F.lit("")) != "", F.col("_rl")).otherwise(bands("HIGH", "MEDIUM", "LOW", "SAFE")).alias("risk_level"),
        bands("RED", "ORANGE", "YELLOW", "GREEN").alias("risk_color"), "behavioral_pattern", "cluster_id", "cluster_size",
        F.when(clustered, F.when(s < 40, "HIGH").when(s < 60, "MEDIUM")).alias("_sig"),
        F.when(scam, "SCAM_CLUSTER").alias("primary_risk_driver"),
        F.when(scam, "SCAM_CLUSTER").otherwise(bands("HIGH_RISK", "MEDIUM_RISK", "LOW_RISK", "SAFE")).alias("category"),
        F.when(clustered, "HIGH").otherwise("MEDIUM").alias("confidence"),
        F.when(scam, F.format_string("Wallet is linked to a scam cluster with %d other members.", F.col("cluster_size") - 1))
        .otherwise("No major threats detected.").alias("summary_message"),
        F.when(F.size(actions) > 0, actions).otherwise(fallback).alias("recommended_actions"),
        rnd((100 - s) / 100, 2).alias("exposure_ratio"),
    ).withColumn("propagation_signal", F.coalesce("_sig", F.lit("LOW"))).drop("_sig")


def wallet_dashboard(scores: DataFrame, transfers: DataFrame, reasons: DataFrame, badges: DataFrame, as_of: int,
                     shown: int | None = None) -> DataFrame:
    """scores: wallet, score, risk_level; badges: wallet, badge, ts.

    Reasons and badges of all rows, or of the newest ``shown`` ones; drainer_pattern regards all reasons in any case.
    """
    ends = both_ends(transfers, "amount_lamports", "ts")
    since = as_of - 30 * DAY
    pairs = ends.groupBy("wallet", "counterparty").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"),
        F.sum(F.when(F.col("ts").isNull() | (F.col("ts") >= since), F.col("amount_lamports"))).alias("v"))
    stats = pairs.groupBy("wallet").agg(
        F.sum("n").alias("total_transactions"), F.count_if(F.col("counterparty") != F.col("wallet")).alias("unique_counterparties"),
        F.min("first").alias("_first"), rnd(F.coalesce(F.sum("v"), F.lit(0)) / float(LAMPORTS_PER_SOL), 2).alias("volume_30d"))
    code, name = F.trim("reason_code"), F.trim("badge")
    if shown is None:
        listed_reasons = _newest_codes(reasons, code, "reasons", "created_at", F.col("tx_hash"))
        latest = badges.groupBy("wallet", name.alias("badge")).agg(F.max("ts").alias("ts"))
        by_name = F.array_sort(F.collect_list(F.struct(F.col("ts").isNull().alias("none"), (-F.col("ts")).alias("ts"), "badge")))
        listed_badges = latest.groupBy("wallet").agg(F.transform(by_name, lambda e: e["badge"]).alias("badges"))
    else:
        top = newest_n(reasons, ["wallet"], [F.desc_nulls_last("created_at"), F.desc("tx_hash")], shown, rank="rank")
        last = newest_n(badges, ["wallet"], [F.desc("ts"), F.col("badge")], shown, rank="rank")
        listed_reasons, listed_badges = _ordered_codes(top, code, "reasons"), _ordered_codes(last, name, "badges")
    drainer = reasons.groupBy("wallet").agg(F.max(code.contains("DRAINER")).alias("_drainer"))
    df = assemble(scores.select("wallet", "score", "risk_level"), stats, listed_reasons, listed_badges, drainer).fillna(
        0, ["total_transactions", "unique_counterparties", "volume_30d"]).fillna(False, ["_drainer"])
    age = F.greatest(F.lit(0), F.coalesce(F.floor((F.lit(as_of) - F.col("_first")) / DAY), F.lit(0)))
    score = F.round(F.coalesce("score", F.lit(0.0))).cast("int")
    tier = F.coalesce(F.trim("risk_level"), F.lit("unknown"))
    listed = F.coalesce("reasons", _NONE())
    return df.select(
        "wallet", score.alias("trust_score"), tier.alias("risk_tier"), age.alias("wallet_age_days"), "total_transactions",
        "unique_counterparties", "volume_30d", (age > 90).alias("long_term_holder"),
        (tier.isin("LOW", "low", "1") | (score >= 70)).alias("low_risk_network"),
        F.col("_drainer").alias("drainer_pattern"), listed.alias("reasons"),
        F.coalesce("badges", _NONE()).alias("badges"))


def investigation_badge(scores: DataFrame, reasons: DataFrame, members: DataFrame, transfers: DataFrame, scam: DataFrame,
                        history: DataFrame, as_of: int) -> DataFrame:
    """reasons: one row per (wallet, code) with weight and created_at; newest first as stored."""
    order = [F.desc("created_at"), F.col("reason_code")]
    top = newest_n(reasons, ["wallet"], order, 5, rank="rank")
    negative = newest_n(reasons.filter("weight < 0"), ["wallet"], order, 5, rank="rank")
    code = F.col("reason_code")
    phrase = F.coalesce(lookup(P.BADGE_PHRASES, code), F.lower(F.replace(code, F.lit("_"), F.lit(" "))))
    clusters = _clusters(members).join(cluster_scam_ratio(members, scam), "cluster_id").select(
        "wallet", "cluster_id", "cluster_size", "scam_ratio")
    any_reason = reasons.groupBy("wallet").agg(F.lit(True).alias("_any"))
    df = assemble(
        scores.select("wallet", rnd(F.coalesce("score", F.lit(50.0)), 2).alias("score")),
        _ordered_codes(top, code, "top_reason_codes"), _ordered_codes(negative, phrase, "_phrases"), any_reason, clusters,
        suspicious_tx_count(transfers, scam).withColumnRenamed("n", "recent_suspicious_tx_count"),
        score_change_30d(scores, history, as_of).withColumnRenamed("change", "score_change_30d"),
    ).fillna(0, ["recent_suspicious_tx_count"])
    b = badge(F.col("score"), "five")["name"]
    text = (F.when(F.col("_any").isNull(), F.concat(F.lit("Wallet marked "), b, F.lit(". No specific reasons on file.")))
            .when(F.coalesce(F.size("_phrases"), F.lit(0)) <= 0, F.concat(F.lit("Wallet marked "), b, F.lit(". No negative indicators.")))
            .otherwise(F.concat(F.lit("Wallet marked "), b, F.lit(" due to "), F.array_join("_phrases", " and "), F.lit("."))))
    return df.select("wallet", "score", b.alias("badge"), text.alias("badge_reason_summary"), "top_reason_codes", "cluster_id",
                     "cluster_size", "scam_ratio", "recent_suspicious_tx_count", "score_change_30d")


def receiver_risk(scores: DataFrame, reasons: DataFrame, members: DataFrame, scam: DataFrame) -> DataFrame:
    """One row per wallet with everything ``check_transfers`` needs to know about a receiver."""
    top = reasons.filter(F.col("reason_code").isNotNull() & (F.col("reason_code") != P.NO_RISK)).groupBy("wallet").agg(
        F.max_by("reason_code", F.struct(F.abs("weight"), F.col("reason_code"))).alias("top_reason"))
    s = scores.select("wallet", F.col("score").alias("to_score"))
    m = members.select("wallet").distinct().withColumn("cluster_link", F.lit(True))
    b = scam.select("wallet").distinct().withColumn("is_scam", F.lit(True))
    wallets = s.select("wallet").union(top.select("wallet")).union(m.select("wallet")).union(b.select("wallet")).distinct()
    return assemble(wallets, s, top, m, b).withColumnRenamed("wallet", "receiver")


def check_transfers(proposed: DataFrame, receivers: DataFrame) -> DataFrame:
    """Risk of each proposed transfer (receiver, amount, token); ``receivers`` comes from ``receiver_risk``."""
    df = proposed.join(receivers, "receiver", "left")
    s, scam = F.col("to_score"), F.coalesce("is_scam", F.lit(False))
    cluster = F.coalesce("cluster_link", F.lit(False))
    level = F.when(scam, 3).when(s < 20, 3).when(s < 40, 2).when(s < 70, 1).otherwise(0)
    text = (F.when(scam, "Receiver is a known scam wallet")
            .when(s < 20, F.coalesce("top_reason", F.lit("Receiver has very low trust score")))
            .when(s < 40, F.coalesce("top_reason", F.lit("Receiver has low trust score")))
            .when(s < 70, "Receiver has moderate risk"))
    confidence = F.when(scam, 1.0).when(s < 20, 0.9).when(s < 40, 0.85).when(s < 70, 0.7).otherwise(0.0)
    large = (F.col("token") == "SOL") & (F.col("amount") >= 10.0) & (level > 0)
    raised = cluster & (level < 3)
    return df.select(
        *proposed.columns, F.when(raised, F.greatest(level, F.lit(2))).otherwise(level).alias("risk_level"),
        F.coalesce(text, F.when(raised, "Receiver linked to scam cluster")).alias("warning_reason"),
        confidence.alias("confidence"), "to_score",
        F.when(s.isNull(), "UNKNOWN").otherwise(badge(s, "transfer")["name"]).alias("to_badge"), "top_reason",
        cluster.alias("cluster_link"),
        F.when(large, "large_transfer_to_risky").when(scam, "drainer_or_scam").alias("special_warning"))


def batch_scores(requested: DataFrame, latest: DataFrame) -> DataFrame:
    df = requested.select("wallet").distinct().join(latest.select("wallet", "score", "computed_at"), "wallet", "left")
    known = F.col("score").isNotNull()
    iso = F.concat(utc_date(F.col("computed_at")).cast("string"), F.lit("T"),
                   F.substring(utc_minute_text(F.col("computed_at")), 12, 5), F.lit(":"),
                   F.lpad((F.col("computed_at") % 60).cast("string"), 2, "0"), F.lit("Z"))
    return df.select("wallet", rnd(F.col("score"), 2).alias("score"),
                     F.when(known, risk_level(F.col("score"), "rank_bands").cast("int")).alias("risk"),
                     F.when(known, iso).alias("updated_at"), F.when(known, "ok").otherwise("not_scored").alias("status"))


def wallet_report(scores: DataFrame, reasons: DataFrame, members: DataFrame, transfers: DataFrame, history: DataFrame,
                  n: int = 10) -> DataFrame:
    """Score, cluster and the newest transfers and snapshots nested in one row per wallet."""
    def nested(df: DataFrame, order: list[Column], limit: int, fields: list[str], name: str) -> DataFrame:
        top = newest_n(df, ["wallet"], order, limit, rank="rank")
        return top.groupBy("wallet").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias(name))

    tx = both_ends(transfers, "signature", "ts", "amount_lamports")
    return assemble(
        scores.select("wallet", "score"), _clusters(members),
        nested(reasons, [F.abs("weight").desc(), F.col("reason_code")], 5, ["reason_code", "weight"], "reasons"),
        nested(tx, [F.desc("ts"), F.desc("signature")], n, ["signature", "counterparty", "amount_lamports", "ts"], "transfers"),
        nested(history, [F.desc("computed_at"), F.desc("id")], n, ["score", "computed_at"], "snapshots"))


def oracle_view(level: str, scores: DataFrame, reputation: DataFrame, clusters: DataFrame, entities: DataFrame,
                members: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Trust view per wallet, entity or cluster.

    scores: wallet, score, computed_at, rules (array); reputation: wallet, trend, avg_7d, avg_30d;
    clusters: cluster_id, confidence, reason_tags, cluster_risk, risk_updated_at; entities: entity_id, score,
    tags, last_updated; history: entity_id, recent, older, trend (as ``entity_history`` gives).
    """
    e = entities.select(F.col("entity_id").alias("cluster_id"), F.col("score").alias("_rep"), F.col("tags").alias("_etags"),
                        F.col("last_updated").alias("_eupd"))
    c = clusters.select("cluster_id", "confidence", F.col("reason_tags").alias("_ctags"), "cluster_risk", "risk_updated_at")
    risk = F.col("cluster_risk")
    if level == "wallet":
        m = members.groupBy("wallet").agg(F.min("cluster_id").alias("cluster_id")).join(c, "cluster_id", "left").join(
            e, "cluster_id", "left").drop("confidence", "risk_updated_at", "_eupd")
        df = assemble(scores.select("wallet", "score", "computed_at", "rules"),
                      reputation.select("wallet", "trend", "avg_7d", "avg_30d"), m)
        rules = F.coalesce("rules", _NONE())
        tags = F.array_distinct(F.concat(F.coalesce("_ctags", _NONE()), F.coalesce("_etags", _NONE())))
        num = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("None"))
        avg = F.when(F.coalesce("avg_7d", "avg_30d").isNotNull(),
                     F.concat(F.lit("; avg_7d="), num("avg_7d"), F.lit("; avg_30d="), num("avg_30d"))).otherwise("")
        s = rnd(F.col("score"), 2)
        return df.select(
            F.col("wallet").alias("id"), s.alias("trust_score"), risk_level(s, "oracle").alias("risk_level"),
            rnd(F.col("_rep"), 2).alias("entity_reputation"), rnd(risk, 2).alias("cluster_risk"), tags.alias("reason_tags"),
            F.col("computed_at").alias("last_updated"),
            F.when(F.size(rules) > 0, F.concat(F.size(rules).cast("string"), F.lit(" anomaly flag(s): "),
                                               F.array_join(F.slice(rules, 1, 5), ", "))).alias("anomaly_summary"),
            F.when(F.col("trend").isNotNull(), F.concat(F.lit("Trend: "), F.col("trend"), avg)).alias("historical_trend"))
    n = members.groupBy("cluster_id").agg(F.count_distinct("wallet").alias("members"))
    trust = 100.0 - F.coalesce(risk, F.lit(0.0))
    if level == "entity":
        df = e.join(c, "cluster_id", "left").join(
            history.select(F.col("entity_id").alias("cluster_id"), "recent", "older", F.col("trend").alias("_t")), "cluster_id", "left")
        text = F.when(F.col("_t").isNotNull(), F.format_string(
            "Entity trend: %s (recent=%.1f, older=%.1f)", F.col("_t"), F.col("recent"), F.col("older")))
        return df.select(
            F.col("cluster_id").cast("string").alias("id"), F.col("_rep").alias("trust_score"),
            risk_level(trust, "oracle").alias("risk_level"), F.col("_rep").alias("entity_reputation"),
            rnd(risk, 2).alias("cluster_risk"), F.coalesce("_etags", _NONE()).alias("reason_tags"),
            F.col("_eupd").alias("last_updated"), F.lit(None).cast("string").alias("anomaly_summary"), text.alias("historical_trend"))
    df = c.join(e, "cluster_id", "left").join(n, "cluster_id", "left")
    text = F.concat(F.lit("confidence="), F.col("confidence").cast("string"), F.lit("; members="),
                    F.coalesce("members", F.lit(0)).cast("string"))
    return df.select(
        F.col("cluster_id").cast("string").alias("id"), rnd(trust, 2).alias("trust_score"),
        risk_level(trust, "oracle").alias("risk_level"), rnd(F.col("_rep"), 2).alias("entity_reputation"),
        rnd(risk, 2).alias("cluster_risk"), F.coalesce("_ctags", _NONE()).alias("reason_tags"),
        F.greatest(F.coalesce("risk_updated_at", F.lit(0)), F.coalesce("_eupd", F.lit(0))).alias("last_updated"),
        F.lit(None).cast("string").alias("anomaly_summary"), text.alias("historical_trend"))


def false_positive_candidates(scores: DataFrame, transfers: DataFrame, scam: DataFrame, members: DataFrame,
                              safe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, rate): low scores with hardly any flow to scam wallets, or wallets known to be safe."""
    low = scores.filter("score < 20").select("wallet", "score")
    ratio4 = cluster_scam_ratio(members, scam, 4).select("cluster_id", "scam_ratio")
    clusters = _clusters(members).join(ratio4, "cluster_id").select("wallet", "scam_ratio")
    df = assemble(low, flow_to_scam(transfers, scam), clusters, safe.select("wallet").distinct().withColumn("_safe", F.lit(True)))
    n, sol = F.coalesce("tx_count", F.lit(0)), F.coalesce("sol", F.lit(0.0))
    hit = ((n <= 1) & (sol < 0.1)) | F.coalesce("_safe", F.lit(False))
    marked = df.select("wallet", "score", n.alias("tx_to_scam"), rnd(sol, 4).alias("sol_to_scam"), "scam_ratio", hit.alias("_hit"))
    rate = marked.agg(F.count(F.lit(1)).alias("low_scores"), F.count_if("_hit").alias("candidates"),
                      rnd(F.coalesce(ratio(F.count_if("_hit"), F.count(F.lit(1))), F.lit(0.0)), 4).alias("rate"))
    return marked.filter("_hit").drop("_hit"), rate


def wallet_pipeline_stats(scores: DataFrame, reasons: DataFrame, penalties: DataFrame, tracked: DataFrame) -> DataFrame:
    """scores: wallet, score, scam_probability, published; penalties: wallet, reason_risk_score; as (metric, value, text)."""
    drainers = reasons.filter(F.col("reason_code").contains("DRAINER")).select("wallet").distinct().withColumn("_d", F.lit(True))
    df = assemble(scores.select("wallet", "score", "scam_probability", "published"),
                  penalties.select("wallet", "reason_risk_score"), drainers)
    sus = (F.coalesce("reason_risk_score", F.lit(0)) >= 30) | (F.coalesce("scam_probability", F.lit(0.0)) >= 0.3)
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("analyzed"), F.count_if(sus).cast("double").alias("suspicious"),
        F.count_if("_d").cast("double").alias("drainers"),
        rnd(F.sum(F.col("score").cast("decimal(28,6)")).cast("double") / F.count("score"), 2).alias("average_score"),
        rnd(F.coalesce(ratio(F.count_if("published"), F.count(F.lit(1))), F.lit(0.0)), 4).alias("publish_rate"),
        F.min_by(F.struct("score", "wallet"), F.struct("score", "wallet")).alias("worst"))
    total = tracked.agg(F.count_distinct("wallet").cast("double").alias("n")).scalar()
    metric = lambda name, value, text=None: F.struct(
        F.lit(name).alias("metric"), value.alias("value"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    rows = F.array(
        metric("tracked", total), *[metric(m, F.col(m)) for m in (
            "analyzed", "suspicious", "drainers", "average_score", "publish_rate")],
        metric("worst_wallet", F.col("worst.score"), F.col("worst.wallet")))
    return one.select(F.explode(rows).alias("m")).select("m.*")


def publish_candidates(latest: DataFrame, review_queue: DataFrame, published: DataFrame, n: int | None = None) -> DataFrame:
    """latest: wallet, final_score, score, risk, metadata_risk, is_test_wallet; published: wallets of the same day."""
    score = F.coalesce("final_score", "score", F.lit(50.0))
    risk = F.coalesce("risk", "metadata_risk", F.lit(1))
    df = latest.filter(~F.coalesce("is_test_wallet", F.lit(False))).select("wallet", score.alias("score"), risk.alias("risk"))
    df = df.filter("score BETWEEN 0 AND 100 AND risk BETWEEN 0 AND 5")
    df = df.join(review_queue.filter("status = 'pending'").select("wallet").distinct(), "wallet", "left_anti").join(
        published.select("wallet").distinct(), "wallet", "left_anti")
    return df if n is None else df.orderBy("wallet").limit(n)
