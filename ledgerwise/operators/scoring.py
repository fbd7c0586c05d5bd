"""Scores built from reasons, time, graph position and model output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import DAY, assemble, both_ends, clamp, in_set, lookup, rnd, split_lag, utc_minute_text
from ledgerwise.functions.scores import (
    badge, cluster_confidence, cluster_risk_penalty, forced_weight, graph_penalty, reputation_decay, risk_level,
    risk_level_from_reasons, time_weighted_penalty,
)
from ledgerwise.operators.graph import adjacency, transfer_edges


def bayes_posterior(reasons: DataFrame, priors: DataFrame, default: float = P.DEFAULT_PRIOR) -> DataFrame:
    """Posterior scam probability: prior odds times one likelihood factor per reason row.

    Factors are added as logarithms per (wallet, code), so many rows of one wallet
    combine map-side and cannot overflow.
    """
    known = reasons.filter("trim(code) <> ''").groupBy("wallet", F.trim("code").alias("code")).agg(
        F.count(F.lit(1)).alias("n"))
    factor = F.coalesce(lookup(P.LIKELIHOODS, F.col("code")), F.lit(1.0))
    total = known.groupBy("wallet").agg(
        F.sum(F.col("n") * F.log(factor)).alias("_log"), F.bool_and(in_set(F.col("code"), P.WEAK_CODES)).alias("_weak"))
    wallets = priors.select("wallet").union(reasons.select("wallet")).distinct()
    prior = clamp(F.coalesce("_p", F.lit(default)), 0.001, 0.999)
    logit = F.log(F.col("prior") / (1 - F.col("prior"))) + F.coalesce("_log", F.lit(0.0))
    df = assemble(wallets, total, priors.select("wallet", F.col("prior").alias("_p"))).withColumn("prior", prior)
    post = clamp(1.0 / (1.0 + F.exp(-logit)), 0.001, 0.999)
    return df.select("wallet", "prior", F.when(F.coalesce("_weak", F.lit(False)), F.col("prior")).otherwise(post)
                     .alias("posterior"))


def latest_prior(history: DataFrame) -> DataFrame:
    return history.filter("posterior IS NOT NULL").groupBy("wallet").agg(
        F.max_by("posterior", F.struct("ts", "posterior")).alias("prior"))


def dynamic_penalty(reasons: DataFrame, cluster: DataFrame) -> DataFrame:
    """Time-weighted penalty of wallets with a scam trigger and a negative weight.

    reasons: wallet, code, weight, days_old, graph_distance; cluster: wallet, cluster_size, flow_amount.
    """
    member = F.col("code") == "SCAM_CLUSTER_MEMBER"
    rows = reasons.join(cluster.select("wallet", "cluster_size", "flow_amount"), "wallet", "left")
    size = F.coalesce(F.nullif(F.coalesce("cluster_size", F.lit(0)), F.lit(0)), F.lit(1))
    conf = cluster_confidence(size, F.lit(1), F.coalesce("flow_amount", F.lit(0)), F.lit(0), F.lit(0.0))
    extra = cluster_risk_penalty(F.lit(-100.0), F.coalesce("graph_distance", F.lit(1)),
                                 F.coalesce("days_old", F.lit(0)), conf)
    g = rows.groupBy("wallet").agg(
        F.bool_or(in_set(F.col("code"), P.SCAM_TRIGGERS)).alias("_trigger"),
        F.bool_or(F.col("weight") < 0).alias("_negative"),
        F.sum(time_weighted_penalty(F.col("weight"), F.col("days_old"))).alias("_timed"),
        F.coalesce(F.sum(F.when(member, extra).cast("decimal(28,9)")), F.lit(0)).cast("double").alias("_extra"),
    )
    total = clamp(F.col("_timed") + F.col("_extra"), -100.0, 100.0).cast("int")
    return g.select("wallet", F.when(F.col("_trigger") & F.col("_negative"), total).otherwise(0).alias("penalty"))


def dynamic_risk_simple(reasons: DataFrame) -> DataFrame:
    g = reasons.groupBy("wallet").agg(
        F.bool_or(in_set(F.col("code"), P.SCAM_TRIGGERS)).alias("_trigger"),
        F.bool_or(F.col("weight") < 0).alias("_negative"),
        F.sum(time_weighted_penalty(F.col("weight"), F.col("days_old"))).alias("_timed"))
    value = F.least(F.lit(60), F.greatest(F.lit(0), -F.col("_timed")))
    return g.select("wallet", F.when(F.col("_trigger") & F.col("_negative"), value).otherwise(0).cast("int").alias("penalty"))


def scam_hops(edges: DataFrame, scam: DataFrame) -> DataFrame:
    """(wallet, scam_hop): 1 or 2 when another scam wallet is that near.

    Each node carries only the least and greatest of its scam neighbours: two ids are
    enough to know whether one of them differs from a given wallet, so the work stays
    linear in the edges.
    """
    adj = adjacency(edges)
    bad = scam.select(F.col("wallet").alias("neighbor")).distinct()
    one = adj.join(bad, "neighbor", "left_semi").groupBy("wallet").agg(
        F.min("neighbor").alias("lo"), F.max("neighbor").alias("hi"))
    hop1 = one.select("wallet", F.lit(1).alias("scam_hop"))
    hop2 = adj.join(one.withColumnRenamed("wallet", "neighbor"), "neighbor").filter(
        "lo <> wallet OR hi <> wallet").select("wallet", F.lit(2).alias("scam_hop")).distinct()
    return hop1.unionByName(hop2).groupBy("wallet").agg(F.min("scam_hop").alias("scam_hop"))


def dynamic_risk_v2(scores: DataFrame, reasons: DataFrame, transfers: DataFrame, scam: DataFrame,
                    as_of: int) -> DataFrame:
    """scores: wallet, ml_score, prior (previous dynamic risk or null)."""
    activity = both_ends(transfers, "ts").groupBy("wallet").agg(
        F.max("ts").alias("last_tx"), F.count_if(F.col("ts") > as_of - DAY).alias("tx_24h"))
    by_reason = reasons.groupBy("wallet").agg(
        F.sum((F.col("weight") * F.coalesce("confidence", F.lit(1.0))).cast("decimal(28,9)")).cast("double").alias("_rp"))
    df = assemble(scores.select("wallet", "ml_score", F.col("prior").alias("_prior")), activity,
                  scam_hops(transfer_edges(transfers), scam), by_reason)
    prior, last = F.coalesce("_prior", F.lit(0.0)), F.coalesce("last_tx", F.lit(0))
    updated = (F.when((prior == 0) & (last == 0), 50.0).when(prior == 0, F.col("ml_score"))
               .otherwise(0.6 * prior + 0.4 * F.col("ml_score")))
    idle = F.when(last == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((F.lit(as_of) - last) / DAY)))
    df = df.withColumns({
        "updated": updated,
        "graph_penalty": F.when(F.col("scam_hop") == 1, -30.0).when(F.col("scam_hop") == 2, -15.0).otherwise(0.0),
        "decay": -2.0 * idle, "activity_boost": 2.0 * F.coalesce("tx_24h", F.lit(0)),
        "reason_penalty": F.coalesce("_rp", F.lit(0.0)),
    }).withColumn("dynamic_risk", clamp(F.col("updated") + F.col("graph_penalty") + F.col("decay") + F.col("activity_boost")))
    return df.withColumn("final_score", clamp(F.col("dynamic_risk") + F.col("reason_penalty"))).select(
        "wallet", "updated", "graph_penalty", "decay", "activity_boost", "dynamic_risk", "reason_penalty", "final_score")


def final_score(ml: DataFrame, reasons: DataFrame, priors: DataFrame, meta: DataFrame, features: DataFrame) -> DataFrame:
    """The score chain, one named column per step.

    ml: wallet, ml_score, scam_prob, n_tokens; reasons: wallet, code, days_old; priors: wallet, prior;
    meta: wallet, wallet_age_days, last_scam_days, graph_distance; features: wallet, cluster_size,
    flow_amount, tx_count.
    """
    weight = forced_weight(F.col("code"), F.coalesce(lookup(P.REASON_WEIGHTS, F.col("code")), F.lit(0)))
    unique = reasons.groupBy("wallet", "code").agg(F.min("days_old").alias("days_old")).withColumn("weight", weight)
    sums = unique.groupBy("wallet").agg(
        F.least(F.lit(40), F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("weight"))), F.lit(0))).alias("positive"),
        F.coalesce(F.sum(F.when(F.col("weight") < 0, F.col("weight"))), F.lit(0)).alias("negative"),
        F.min("weight").alias("_low"), F.collect_set("code").alias("_codes"))
    placed = unique.join(meta.select("wallet", "graph_distance"), "wallet", "left").withColumn(
        "graph_distance", F.coalesce("graph_distance", F.lit(999)))
    df = assemble(
        ml.select("wallet", "ml_score", "scam_prob", "n_tokens"),
        meta.select("wallet", "wallet_age_days", "last_scam_days", "graph_distance"),
        features.select("wallet", "cluster_size", "flow_amount", "tx_count"), sums,
        bayes_posterior(unique, priors).select("wallet", F.col("posterior").alias("_post")),
        dynamic_penalty(placed, features).select("wallet", F.col("penalty").alias("_dyn")),
    ).fillna(0, ["wallet_age_days", "tx_count", "positive", "negative", "_dyn"])
    empty = (F.col("wallet_age_days") == 0) & (F.col("tx_count") == 0)
    thin = (F.col("scam_prob") < 0.05) & (F.col("n_tokens") <= 1)
    df = df.withColumn("base", F.when(empty | F.coalesce(thin, F.lit(False)), 50.0).otherwise(F.col("ml_score").cast("double")))
    df = df.withColumn("adjusted", F.col("base") + F.col("positive"))
    share = F.least(F.abs("negative") / 100.0, F.lit(0.9))
    df = df.withColumn("soft_penalty", F.least(F.col("adjusted") * share, 0.7 * F.col("adjusted")))
    df = df.withColumn("after_reasons", (F.col("adjusted") - F.col("soft_penalty")).cast("bigint"))
    df = df.withColumn("posterior", F.when(empty, 0.0).otherwise(F.coalesce("_post", F.lit(P.DEFAULT_PRIOR))))
    bayes = (F.col("posterior") * 100).cast("bigint")
    df = df.withColumn("after_risk", clamp(F.col("after_reasons") + F.col("_dyn") - bayes, 0, 100))
    found = F.coalesce("_codes", F.array().cast("array<string>"))
    has = lambda c: F.array_contains(found, c)
    cap = F.least(
        F.when((F.size(found) == 1) & has("CLEAN_HISTORY"), 80).otherwise(100),
        F.when(has("NEW_WALLET"), 60).otherwise(100), F.when(has("LOW_ACTIVITY"), 70).otherwise(100))
    df = df.withColumn("capped", F.least(F.col("after_risk"), cap))
    aged = reputation_decay(F.col("capped"), F.col("wallet_age_days"), F.coalesce("last_scam_days", F.lit(9999)))
    df = df.withColumn("after_age", aged["score"])
    df = df.withColumn("final_score", graph_penalty(F.col("after_age"), F.coalesce("graph_distance", F.lit(999)))["score"])
    return df.select(
        "wallet", "base", "positive", "negative", "after_reasons", F.col("_dyn").alias("dynamic_penalty"), "posterior",
        "after_risk", "capped", "after_age", F.col("final_score").cast("int").alias("final_score"),
        risk_level(F.col("final_score"), "label").alias("risk"),
        risk_level_from_reasons(found, F.coalesce("_low", F.lit(0))).alias("risk_level"))


def score_recovery(scores: DataFrame, transfers: DataFrame, reasons: DataFrame, scam: DataFrame, programs: list[str],
                   as_of: int) -> DataFrame:
    """Wallets whose score rises because nothing suspicious happened for 30, 60 or 90 days."""
    flagged = reasons.filter(in_set(F.col("reason_code"), P.CLUSTER_CODES)).select("wallet")
    bad = scam.select("wallet").union(flagged).distinct().withColumn("_bad", F.lit(True))
    lanes = transfers.groupBy("sender", "receiver", "program_id").agg(F.max("ts").alias("ts"))
    marked = lanes.join(bad.withColumnsRenamed({"wallet": "sender", "_bad": "_s"}), "sender", "left").join(
        bad.withColumnsRenamed({"wallet": "receiver", "_bad": "_r"}), "receiver", "left")
    hit = F.col("_s").isNotNull() | F.col("_r").isNotNull()
    if programs:
        hit = hit | F.coalesce(F.col("program_id").isin(*programs), F.lit(False))
    last_tx = marked.filter(hit).select(F.explode(F.array("sender", "receiver")).alias("wallet"), "ts").groupBy(
        "wallet").agg(F.max("ts").alias("_tx_ts"))
    last_reason = reasons.groupBy("wallet").agg(
        F.max(F.when(in_set(F.col("reason_code"), P.SUSPICIOUS_CODES), F.col("created_at"))).alias("_reason_ts"),
        F.bool_and(in_set(F.col("reason_code"), P.CLEAN_CODES)).alias("_clean"))
    df = assemble(scores.select("wallet", F.coalesce("score", F.lit(50.0)).cast("int").alias("old")), last_tx, last_reason)
    days = (F.lit(as_of) - F.coalesce("_tx_ts", "_reason_ts")) / float(DAY)
    bonus = F.when(days >= 90, 20).when(days >= 60, 10).when(days >= 30, 5).otherwise(0)
    new = F.greatest(F.lit(0), F.least(F.when(F.col("_clean"), 100).otherwise(80), F.col("old") + bonus))
    return df.withColumns({"new": new, "days_clean": F.floor(days), "_bonus": bonus}).filter(
        "_bonus > 0 AND new > old").select("wallet", "old", "new", "days_clean",
                                           risk_level(F.col("new"), "recovery").alias("risk_level"))


def combine_scores(ml: DataFrame, penalties: DataFrame, codes: DataFrame) -> DataFrame:
    score = clamp(F.col("ml_score") - F.coalesce("penalty_score", F.lit(0)))
    df = assemble(ml.select("wallet", "ml_score"), penalties.select("wallet", "penalty_score"),
                  codes.select("wallet", "reason_codes"))
    return df.withColumn("_s", score).select(
        "wallet", rnd(F.col("_s"), 2).alias("score"), risk_level(F.col("_s"), "combined").alias("risk_level"),
        F.coalesce("reason_codes", F.lit("")).alias("reason_codes"))


def capped_reason_score(base: DataFrame, reasons: DataFrame) -> DataFrame:
    w = F.col("weight")
    sums = reasons.groupBy("wallet").agg(F.coalesce(F.sum(F.when(w > 0, w)), F.lit(0)).alias("_p"),
                                         F.coalesce(F.sum(F.when(w < 0, w)), F.lit(0)).alias("_n"))
    return base.select("wallet", "score").join(sums, "wallet", "left").select(
        "wallet", clamp(F.col("score") + F.least(F.lit(40), F.coalesce("_p", F.lit(0))) + F.coalesce("_n", F.lit(0)))
        .alias("score"))


def badge_changes(score_timeline: DataFrame) -> DataFrame:
    """(wallet, badge, ts) whenever the badge differs from the one before."""
    rows = score_timeline.select("wallet", badge(F.col("score"))["name"].alias("badge"), F.col("computed_at").alias("ts"), "id")
    lagged = split_lag(rows, ["wallet"], F.floor(F.col("ts") / DAY), ["ts", "id"], "badge", "_before")
    return lagged.filter(~F.col("badge").eqNullSafe(F.col("_before"))).select("wallet", "badge", "ts")


def badge_timeline(history: DataFrame, current: DataFrame, as_of: int) -> DataFrame:
    """Badge at every snapshot, plus the current score where it moved more than 0.5 since the last one.

    history: wallet, score, posterior, snapshot_at.
    """
    score = F.coalesce("score", (1 - F.coalesce("posterior", F.lit(0.5))) * 100)
    past = history.select("wallet", F.col("snapshot_at").alias("ts"), score.cast("double").alias("_s"))
    last = past.groupBy("wallet").agg(F.max_by(F.round("_s"), F.struct("ts", "_s")).alias("_last"))
    now = current.select("wallet", F.coalesce("score", F.lit(50.0)).alias("_s")).join(last, "wallet", "left").filter(
        "_last IS NULL OR abs(_last - _s) > 0.5").select("wallet", F.lit(as_of).cast("bigint").alias("ts"), "_s")
    return past.unionByName(now).select(
        "wallet", utc_minute_text(F.col("ts")).alias("date"), badge(F.col("_s"))["name"].alias("badge"),
        F.round("_s").cast("int").alias("score"))


def force_scam_scores(scores: DataFrame, scam: DataFrame, as_of: int) -> DataFrame:
    """Scores with every known scam wallet at 0 / HIGH; scam wallets without a score are added."""
    bad = scam.select("wallet").distinct().withColumn("_bad", F.lit(True))
    hit = F.col("_bad").isNotNull()
    codes = F.coalesce(F.trim("reason_codes"), F.lit(""))
    return scores.join(bad, "wallet", "full").select(
        "wallet", F.when(hit, 0.0).otherwise(F.col("score")).alias("score"),
        F.when(hit, "HIGH").otherwise(F.col("risk_level")).alias("risk_level"),
        F.when(hit & (codes == ""), "scam_wallet").when(hit, F.concat("reason_codes", F.lit(",scam_wallet")))
        .otherwise(F.col("reason_codes")).alias("reason_codes"),
        F.when(hit, F.lit(as_of)).otherwise(F.col("updated_at")).cast("bigint").alias("updated_at"))


def fill_missing_scores(scores: DataFrame, reasons: DataFrame, as_of: int) -> DataFrame:
    missing = reasons.select("wallet").distinct().join(scores, "wallet", "left_anti").select(
        "wallet", F.lit(50.0).alias("score"), F.lit(as_of).cast("bigint").alias("updated_at"))
    return scores.select("wallet", "score", "updated_at").unionByName(missing)
