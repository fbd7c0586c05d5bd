"""Score and activity histories: latest rows, rolling statistics, trends, reputation, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import (
    DAY, assemble, both_ends, clamp, codes, in_set, lookup, newest_n, ratio, rnd, split_rank, stable_avg,
    title_case, utc_date,
)
from ledgerwise.functions.scores import inactivity_decay
from ledgerwise.sources.tables import incremental_append


def latest_scores(score_timeline: DataFrame) -> DataFrame:
    """The newest row of each wallet: one aggregation, combined map-side."""
    rest = [c for c in score_timeline.columns if c != "wallet"]
    newest = F.max_by(F.struct(*rest), F.struct("computed_at", "id"))
    return score_timeline.groupBy("wallet").agg(newest.alias("_r")).select("wallet", "_r.*")


def score_timeline(timeline: DataFrame, since: int | None = None, until: int | None = None,
                   limit: int | None = None) -> DataFrame:
    df = timeline
    if since is not None:
        df = df.filter(F.col("computed_at") >= since)
    if until is not None:
        df = df.filter(F.col("computed_at") <= until)
    if limit is None:
        return df
    return newest_n(df, ["wallet"], [F.desc("computed_at"), F.desc("id")], limit, salt_cols=["id"])


def rolling_stats(transfers: DataFrame, timeline: DataFrame, alerts: DataFrame, as_of: int, days: int) -> DataFrame:
    """Totals of the ``days`` ending at ``as_of`` for every wallet seen in any of the inputs."""
    inside = lambda c: F.col(c).between(as_of - days * DAY, as_of)
    tx = transfers.filter(inside("ts")).groupBy("wallet").agg(
        F.sum("amount_lamports").alias("volume"), F.count(F.lit(1)).alias("tx_count"))
    sc = timeline.filter(inside("computed_at")).groupBy("wallet").agg(
        F.count_if("is_anomalous").alias("anomaly_count"), rnd(stable_avg(F.col("score")), 2).alias("avg_score"))
    al = alerts.filter(inside("created_at")).groupBy("wallet").agg(F.count(F.lit(1)).alias("alert_count"))
    wallets = transfers.select("wallet").union(timeline.select("wallet")).union(alerts.select("wallet")).distinct()
    out = assemble(wallets, tx, sc, al).fillna(0, ["volume", "tx_count", "anomaly_count", "alert_count"])
    return out.withColumn("window_days", F.lit(days))


def baseline(rolling_history: DataFrame, n: int = 8, min_periods: int = 2) -> DataFrame:
    """Medians of the newest ``n`` periods per (wallet, window); fewer than two periods give none."""
    recent = newest_n(rolling_history, ["wallet", "window_days"], [F.desc("period_end")], n)
    mid = lambda c: F.median(c).cast("bigint").alias(c)
    return recent.groupBy("wallet", "window_days").agg(
        F.count(F.lit(1)).alias("_n"), mid("volume"), mid("tx_count"), mid("anomaly_count"),
        rnd(F.median("avg_score"), 2).alias("avg_score"), mid("alert_count"),
    ).filter(F.col("_n") >= min_periods).drop("_n")


def behavior_trend(current: DataFrame, base: DataFrame, delta: float = 5.0, shift: float = 2.0) -> DataFrame:
    """Current totals against the baseline (30 days preferred to 7); wallets without one are STABLE."""
    measures = ["volume", "tx_count", "anomaly_count", "avg_score", "alert_count"]
    chosen = base.groupBy("wallet").agg(
        F.max_by(F.struct("window_days", *measures), F.col("window_days")).alias("b"))
    wallets = current.select("wallet").distinct()
    c = current.select("wallet", F.struct(*measures).alias("c"), "window_days")
    df = wallets.join(chosen, "wallet", "left").withColumn("window_days", F.coalesce("b.window_days", F.lit(7)))
    df = df.join(c, ["wallet", "window_days"], "left")
    cv, bv = (lambda m: F.col(f"c.{m}")), (lambda m: F.col(f"b.{m}"))
    diff = cv("avg_score") - bv("avg_score")
    known = F.col("b").isNotNull()
    vol = ratio(cv("volume"), F.nullif(bv("volume"), F.lit(0)))
    tx = ratio(cv("tx_count"), F.nullif(bv("tx_count"), F.lit(0)))
    anom = ratio(cv("anomaly_count"), F.when(bv("anomaly_count") > 0, bv("anomaly_count")).otherwise(1))
    alert = ratio(cv("alert_count"), F.when(bv("alert_count") > 0, bv("alert_count")).otherwise(1))
    moved = lambda r: (r >= shift) | (r <= 1.0 / shift)
    text = lambda name, x: F.concat(F.lit(name + "="), rnd(x, 2).cast("string"))
    direction = F.when(diff >= delta, "up").when(diff <= -delta, "down").otherwise("stable")
    score_text = F.concat(F.lit("trust_score_"), direction, F.lit("_delta="), rnd(diff, 2).cast("string"))
    reasons = codes(
        (~known, "no_baseline_insufficient_history"), (known & diff.isNotNull(), score_text),
        (known & moved(vol), text("volume_ratio", vol)), (known & moved(tx), text("tx_count_ratio", tx)),
        (known & (anom >= shift), text("anomaly_count_ratio", anom)),
        (known & (alert >= shift), text("alert_count_ratio", alert)),
    )
    shifted = F.coalesce(known & (F.coalesce(moved(vol), F.lit(False)) | F.coalesce(moved(tx), F.lit(False))
                                  | F.coalesce(anom >= shift, F.lit(False)) | F.coalesce(alert >= shift, F.lit(False))),
                         F.lit(False))
    trend = (F.when(shifted, "BEHAVIORAL_SHIFT_DETECTED").when(known & (diff >= delta), "TREND_UP")
             .when(known & (diff <= -delta), "TREND_DOWN").otherwise("STABLE"))
    filled = F.when(F.size("reasons") == 0, F.array(F.lit("first_baseline_or_stable"))).otherwise(F.col("reasons"))
    return df.select("wallet", trend.alias("trend"), shifted.alias("shift"), reasons.alias("reasons")).withColumn(
        "reasons", filled)


def reputation_state(timeline: DataFrame, as_of: int) -> DataFrame:
    """Current score, 7 and 30 day means, trend, volatility and inactivity factor."""
    past = timeline.filter((F.col("computed_at") <= as_of) & F.col("score").isNotNull())
    week, month = (F.col("computed_at") >= as_of - d * DAY for d in (7, 30))
    score = F.col("score")
    squares = F.when(month, score * score)
    m = F.when(month, score)
    var = ratio(F.sum(squares.cast("decimal(30,6)")), F.count(m)) - F.pow(stable_avg(m), F.lit(2))
    g = past.groupBy("wallet").agg(
        F.max_by("score", F.struct("computed_at", "id")).alias("_now"), F.max("computed_at").alias("_last"),
        rnd(stable_avg(F.when(week, score)), 2).alias("avg_7d"), rnd(stable_avg(m), 2).alias("avg_30d"),
        F.when(F.count(m) >= 2, rnd(F.sqrt(F.greatest(F.lit(0.0), var)), 2)).alias("volatility"),
    )
    current = rnd(F.col("_now"), 2)
    diff = current - F.coalesce("avg_30d", "avg_7d")
    trend = F.when(diff >= 3, "improving").when(diff <= -3, "degrading").otherwise("stable")
    recent = F.when(F.col("_last") >= as_of - 365 * DAY, F.col("_last"))
    return g.select("wallet", current.alias("current"), "avg_7d", "avg_30d", trend.alias("trend"), "volatility",
                    rnd(inactivity_decay(recent, as_of), 4).alias("decay_factor"))


def entity_reputation(members: DataFrame, latest: DataFrame, alerts: DataFrame, previous: DataFrame, as_of: int,
                      count_only_anomalous: bool = False) -> DataFrame:
    """Cluster reputation: decayed previous score less anomaly, alert and spread penalties.

    previous: entity_id, score, last_updated.
    """
    m = members.select("cluster_id", "wallet").distinct()
    penalty = F.coalesce(lookup(P.ALERT_SEVERITY_PENALTY, F.lower(F.trim("severity"))), F.lit(1.0))
    per_wallet = alerts.filter(F.col("created_at") >= as_of - 7 * DAY).groupBy("wallet").agg(F.sum(penalty).alias("_ap"))
    rows = m.join(latest.select("wallet", F.lit(1).alias("_meta"), "is_anomalous"), "wallet", "left").join(
        per_wallet, "wallet", "left")
    g = rows.groupBy(F.col("cluster_id").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("members"), F.count("_meta").alias("_n_meta"), F.count_if("is_anomalous").alias("risky"),
        F.coalesce(F.sum("_ap"), F.lit(0.0)).alias("alert_penalty"))
    df = g.join(previous.select("entity_id", F.col("score").alias("_p"), F.col("last_updated").alias("_u")), "entity_id", "left")
    prev = F.coalesce("_p", F.lit(50.0))
    days = (F.lit(as_of) - F.coalesce("_u", F.lit(as_of - 365 * DAY))) / float(DAY)
    decayed = F.when(days <= 0, prev).otherwise(50 + (prev - 50) * F.pow(F.lit(0.5), days / 90))
    n = F.col("risky") if count_only_anomalous else F.col("_n_meta")
    spread = F.when(F.col("members") >= 2, F.col("risky") * 0.5).otherwise(0.0)
    score = clamp(rnd(decayed - 4.0 * n - F.col("alert_penalty") - spread, 2))
    df = df.withColumns({"_score": score, "_count": n, "_prev": prev, "spread_penalty": spread})
    tags = codes(
        (F.col("risky") > 0, "cluster_contamination"), (F.col("_count") >= 2, "repeated_anomalies"),
        ((F.col("_count") == 0) & (F.col("alert_penalty") == 0) & (F.col("_prev") < 70) & (F.col("_score") >= 70),
         "behavior_recovery"))
    return df.select(
        "entity_id", F.col("_score").alias("score"), tags.alias("tags"),
        clamp(1.0 - days / 90 * 0.1, 0.5, 1.0).alias("decay_factor"),
        F.struct(F.lit(as_of).cast("bigint").alias("at"), F.col("_score").alias("reputation_score"),
                 F.col("_count").alias("anomaly_count"), rnd(F.col("alert_penalty"), 2).alias("alert_penalty"),
                 rnd(F.col("spread_penalty"), 2).alias("spread_penalty")).alias("snapshot"))


def entity_modifier(entity: DataFrame, members: DataFrame, scores: DataFrame) -> DataFrame:
    rep = members.join(entity.select(F.col("entity_id").alias("cluster_id"), F.col("score").alias("_rep")), "cluster_id")
    one = rep.groupBy("wallet").agg(F.min_by("_rep", "cluster_id").alias("_rep"))
    modifier = F.coalesce(clamp(rnd((F.col("_rep") - 50) * 0.2, 2), -10.0, 10.0), F.lit(0.0))
    return scores.select("wallet", F.col("score").alias("_s")).join(one, "wallet", "left").select(
        "wallet", modifier.alias("modifier"), clamp(rnd(F.col("_s") + modifier, 2)).alias("score"))


def entity_history(history: DataFrame, snapshot: DataFrame, keep: int | None = None,
                   trend_over: int = 10) -> tuple[DataFrame, DataFrame]:
    """(history, trend): appended snapshots, all or the newest ``keep`` per entity; newest against the oldest of the last ten."""
    rows = history.unionByName(snapshot.select(*history.columns))
    order = [F.desc("at"), F.desc("score")]
    if keep is None:
        late = F.coalesce(-F.floor(F.col("at") / DAY), F.lit(2**62))
        kept = split_rank(rows, ["entity_id"], late, order, total="_total").drop("_total")
    else:
        kept = newest_n(rows, ["entity_id"], order, keep, rank="rank")
    last = kept.filter(F.col("rank") <= trend_over).groupBy("entity_id").agg(
        F.min_by("score", "rank").alias("recent"), F.max_by("score", "rank").alias("older"), F.count(F.lit(1)).alias("n"))
    trend = (F.when(F.col("n") < 2, None).when(F.col("recent") > F.col("older"), "improving")
             .when(F.col("recent") < F.col("older"), "degrading").otherwise("stable"))
    return kept, last.select("entity_id", trend.alias("trend"), "recent", "older")


def score_snapshot(scores: DataFrame, as_of: int, history: DataFrame | None = None) -> DataFrame:
    snap = scores.select("wallet", F.lit(as_of).cast("bigint").alias("ts"), F.coalesce("score", F.lit(50.0)).alias("score"),
                         F.coalesce("risk", F.lit(1)).alias("risk"))
    return snap if history is None else incremental_append(history, snap, ["wallet", "ts"])[0]


def score_change_30d(scores: DataFrame, history: DataFrame, as_of: int) -> DataFrame:
    """Current score less the newest snapshot at or before 30 days ago (null when there is none)."""
    old = history.filter(F.col("snapshot_at") <= as_of - 30 * DAY).groupBy("wallet").agg(
        F.max_by(F.coalesce("score", (1 - F.coalesce("posterior", F.lit(0.5))) * 100), F.struct("snapshot_at", "id")).alias("_old"))
    return scores.select("wallet", "score").join(old, "wallet", "left").select(
        "wallet", rnd(F.col("score") - F.col("_old"), 1).alias("change"))


def previous_score(history: DataFrame) -> DataFrame:
    """The second newest score of each wallet."""
    two = newest_n(history, ["wallet"], [F.desc("computed_at"), F.desc("id")], 2, rank="_rank")
    return two.filter("_rank = 2").select("wallet", F.col("score").alias("prev_score"), F.col("computed_at").alias("prev_ts"))


def review_triggers(scores: DataFrame, reasons: DataFrame, history: DataFrame, clusters: DataFrame, queue: DataFrame,
                    as_of: int) -> DataFrame:
    """Wallets to review with the first reason that applies.  scores: wallet, score, confidence;
    clusters: wallet, cluster_size."""
    scam = reasons.groupBy("wallet").agg(F.bool_or(in_set(F.col("reason_code"), P.SUSPICIOUS_CODES)).alias("_scam"))
    queued = queue.select("wallet").distinct().withColumn("_queued", F.lit(True))
    df = assemble(scores.select("wallet", "score", "confidence"), scam, previous_score(history),
                  clusters.select("wallet", "cluster_size"), queued)
    has = F.coalesce("_scam", F.lit(False))
    hint = F.coalesce(
        F.when((F.col("score") < 20) & (F.col("confidence") < 0.7), "low_score_low_confidence"),
        F.when((F.lit(as_of) - F.col("prev_ts") <= DAY) & (F.abs(F.col("score") - F.col("prev_score")) > 40), "score_spike"),
        F.when(has & F.col("_queued").isNull(), "new_scam_reason"),
        F.when(F.col("cluster_size").between(1, 4) & has, "small_cluster_scam"))
    risk = F.when(F.col("score") < 30, 1).when(F.col("score") < 60, 2).otherwise(3)
    return df.withColumn("hint", hint).filter("hint IS NOT NULL").select(
        "wallet", "score", "confidence", risk.alias("risk"), "hint", F.lit(as_of).cast("bigint").alias("created_at"),
        F.lit("pending").alias("status"))


def review_status(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue with the newest decision (approved / rejected) applied."""
    last = decisions.groupBy("wallet").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("_d"))
    return queue.join(last, "wallet", "left").withColumn("status", F.coalesce("_d", "status")).drop("_d")


def pending_reviews(queue: DataFrame, n: int | None = None) -> DataFrame:
    out = queue.filter("status = 'pending'").orderBy(F.desc("created_at"), "wallet")
    return out if n is None else out.limit(n)


def activity_heatmap(transfers: DataFrame) -> DataFrame:
    """Transfers per (wallet, day of week with Sunday = 0, hour), both in UTC."""
    ts = F.col("ts")
    return both_ends(transfers, "ts").filter("ts IS NOT NULL").groupBy(
        "wallet", ((F.floor(ts / DAY) + 4) % 7).cast("int").alias("day"),
        (F.floor(ts / 3600) % 24).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("tx_count"))


def daily_activity(transfers: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    return both_ends(transfers, "ts").filter(F.col("ts") >= as_of - days * DAY).groupBy(
        "wallet", utc_date(F.col("ts")).cast("string").alias("date")).agg(F.count(F.lit(1)).alias("tx"))


def needs_refresh(scores: DataFrame, transfers: DataFrame, wallets: DataFrame) -> DataFrame:
    """scores: wallet, last_updated.  A wallet needs a refresh when it has a newer transfer or no score."""
    last = both_ends(transfers, "ts").groupBy("wallet").agg(F.max("ts").alias("_ts"))
    df = assemble(wallets.select("wallet").distinct(), scores.select("wallet", "last_updated", F.lit(True).alias("_c")), last)
    cached = F.coalesce("_c", F.lit(False))
    newer = F.coalesce(F.col("_ts") > F.coalesce("last_updated", F.lit(0)), F.lit(False))
    return df.select("wallet", cached.alias("cached"), (~cached | newer).alias("needs_refresh"), "last_updated")


def risk_timeline(reasons: DataFrame) -> DataFrame:
    """Reasons in time order as rows (wallet, position, ...); positions count per wallet."""
    rows = reasons.select("wallet", "created_at", "reason_code", "weight", "confidence", "tx_hash")
    return split_rank(rows, ["wallet"], F.floor(F.col("created_at") / DAY),
                      [F.col("created_at"), F.col("tx_hash"), F.col("reason_code")], rank="position").drop("total")


def event_timeline(history: DataFrame, reasons: DataFrame, transfers: DataFrame, members: DataFrame,
                   latest: DataFrame) -> DataFrame:
    """All dated events of each wallet (sort by wallet, date for display).

    history: wallet, snapshot_at; latest: wallet, computed_at, used to date cluster events.
    """
    def event(df: DataFrame, date: Column, text: Column | str, kind: Column | str, level: Column | str) -> DataFrame:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select("wallet", date.cast("bigint").alias("date"), as_col(text).alias("event"),
                         as_col(kind).alias("type"), as_col(level).alias("risk_level"))

    code = F.col("reason_code")
    risky = code.rlike("SCAM|DRAINER|RISKY|BLACKLIST|RUG")
    tx = both_ends(transfers, "ts").groupBy("wallet").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    sizes = members.groupBy("cluster_id").agg(F.count_distinct("wallet").alias("size"))
    linked = members.select("wallet", "cluster_id").distinct().join(sizes, "cluster_id").join(
        latest.select("wallet", "computed_at"), "wallet", "left")
    first = history.groupBy("wallet").agg(F.min("snapshot_at").alias("ts"))
    when = F.coalesce("computed_at", F.lit(0))
    began = F.coalesce("first_ts", F.lit(0))
    parts = [
        event(history, F.col("snapshot_at"), "Activity snapshot recorded", "activity", "LOW"),
        event(reasons.filter("created_at IS NOT NULL"), F.col("created_at"),
              F.coalesce(lookup(P.REASON_EVENTS, code), title_case(code)), F.when(risky, "risk").otherwise("info"),
              F.coalesce(lookup(P.REASON_EVENT_RISK, code), F.lit("LOW"))),
        event(tx.filter("first_ts IS NOT NULL"), F.col("first_ts"), "First transaction detected", "milestone", "LOW"),
        event(tx.filter("n >= 10"), began, "Wallet became active (10+ transactions)", "milestone", "LOW"),
        event(tx.filter("n >= 100"), began, "High activity wallet detected (100+ transactions)", "milestone", "LOW"),
        event(linked.filter("size > 3"), when, "Wallet linked to risk cluster", "propagation", "HIGH"),
        event(linked.filter("size > 10"), when, "Risk propagated across network cluster", "propagation", "CRITICAL"),
        event(first, F.col("ts"), "First activity detected", "activity", "LOW"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("severity", lookup(P.EVENT_SEVERITY, F.col("risk_level")))


def top_risky(timeline: DataFrame, n: int = 10) -> DataFrame:
    return latest_scores(timeline).select("wallet", "score").orderBy("score", "wallet").limit(n)
