"""Time-series, alert and state queries."""

from pyspark.sql import functions as F

from catalog.features import test_flags
from catalog.reasons import sql_set
from catalog.registry import constant_view, query
from catalog.views import AS_OF, DAY, SQL_VIEWS
from ledgerwise import params as P
from ledgerwise.functions import scores as S
from ledgerwise.operators import alerts as A
from ledgerwise.operators import propagation as R
from ledgerwise.operators import timeseries as T

D = "::DOUBLE"
SUM6 = "sum(CAST({c} AS DECIMAL(28, 6)))::DOUBLE"


@query("w01_latest_scores", "SELECT wallet, score, computed_at, is_anomalous FROM latest_scores")
def _(v):
    return T.latest_scores(v.score_timeline).drop("id")


@query("w02_score_timeline", f"""SELECT wallet, score, computed_at FROM score_timeline WHERE computed_at BETWEEN {AS_OF - 20 * DAY} AND {AS_OF - DAY}
    QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY computed_at DESC, id DESC) <= 10""")
def _(v):
    return T.score_timeline(v.score_timeline, AS_OF - 20 * DAY, AS_OF - DAY, 10).select("wallet", "score", "computed_at")


def _roll(days: int, as_of: int = AS_OF) -> str:
    r = f"BETWEEN {as_of - days * DAY} AND {as_of}"
    return f"""SELECT w.wallet, {days} AS window_days, coalesce(volume, 0) AS volume, coalesce(tx_count, 0) AS tx_count,
      coalesce(anomaly_count, 0) AS anomaly_count, avg_score, coalesce(alert_count, 0) AS alert_count
      FROM (SELECT wallet FROM transfers UNION SELECT wallet FROM alerts) w
      LEFT JOIN (SELECT wallet, CAST(sum(amount_lamports) AS BIGINT) AS volume, count(*) AS tx_count FROM transfers WHERE ts {r} GROUP BY 1) USING (wallet)
      LEFT JOIN (SELECT wallet, count(*) FILTER (is_anomalous) AS anomaly_count, round({SUM6.format(c='score')} / count(*) * 100) / 100 AS avg_score
        FROM score_timeline WHERE computed_at {r} GROUP BY 1) USING (wallet)
      LEFT JOIN (SELECT wallet, count(*) AS alert_count FROM alerts WHERE created_at {r} GROUP BY 1) USING (wallet)"""


SQL_VIEWS["roll7"] = _roll(7)
SQL_VIEWS["roll30"] = _roll(30)


def roll(v, days):
    return T.rolling_stats(v.transfers, v.score_timeline, v.alerts, AS_OF, days)


@query("w03_rolling_stats", "SELECT * FROM roll7 UNION ALL SELECT * FROM roll30")
def _(v):
    return roll(v, 7).unionByName(roll(v, 30))


# history: one period per 4 days for all wallets (7-day window), one per 10 days for calm ones (30-day window)
def _hist(days, step, where):
    return f"""SELECT wallet, {days} AS window_days, max(ts) AS period_end, CAST(sum(amount_lamports) AS BIGINT) AS volume, count(*) AS tx_count,
      count(err) AS anomaly_count, round({SUM6.format(c="amount_lamports / CAST(1e9 AS DOUBLE)")} / count(*) * 100) / 100 AS avg_score, count(err) AS alert_count
      FROM transfers WHERE {where} GROUP BY wallet, ts // {step * DAY}"""


SQL_VIEWS["roll_hist"] = _hist(7, 4, "true") + " UNION ALL " + _hist(30, 10, "true")
SQL_VIEWS["base_line"] = """SELECT wallet, window_days, CAST(trunc(median(volume)) AS BIGINT) AS volume, CAST(trunc(median(tx_count)) AS BIGINT) AS tx_count,
    CAST(trunc(median(anomaly_count)) AS BIGINT) AS anomaly_count, round(median(avg_score) * 100) / 100 AS avg_score,
    CAST(trunc(median(alert_count)) AS BIGINT) AS alert_count FROM (SELECT * FROM roll_hist
      QUALIFY row_number() OVER (PARTITION BY wallet, window_days ORDER BY period_end DESC) <= 8) GROUP BY 1, 2 HAVING count(*) >= 2"""


def roll_hist(v):
    def part(df, days, step):
        sol = (F.col("amount_lamports") / 1e9).cast("decimal(28,6)")
        return df.groupBy("wallet", F.floor(F.col("ts") / (step * DAY)).alias("p")).agg(
            F.max("ts").alias("period_end"), F.sum("amount_lamports").alias("volume"), F.count(F.lit(1)).alias("tx_count"),
            F.count("err").alias("anomaly_count"),
            T.rnd(F.sum(sol).cast("double") / F.count(F.lit(1)), 2).alias("avg_score"), F.count("err").alias("alert_count"),
        ).drop("p").withColumn("window_days", F.lit(days))

    return part(v.transfers, 7, 4).unionByName(part(v.transfers, 30, 10))


@query("w04_baseline", "SELECT * FROM base_line")
def _(v):
    return T.baseline(roll_hist(v))


_R = "(round({x} * 100) / 100)::VARCHAR"
SQL_VIEWS["trend_in"] = """SELECT *, c_score - b_score AS diff, c_vol / nullif(b_vol, 0)::DOUBLE AS vr, c_tx / nullif(b_tx, 0)::DOUBLE AS tr,
    c_an / (CASE WHEN b_an > 0 THEN b_an ELSE 1 END)::DOUBLE AS ar, c_al / (CASE WHEN b_al > 0 THEN b_al ELSE 1 END)::DOUBLE AS lr FROM (
    SELECT w.wallet, b.wallet IS NOT NULL AS known, c.volume AS c_vol, c.tx_count AS c_tx, c.anomaly_count AS c_an, c.avg_score AS c_score, c.alert_count AS c_al,
      b.volume AS b_vol, b.tx_count AS b_tx, b.anomaly_count AS b_an, b.avg_score AS b_score, b.alert_count AS b_al
    FROM (SELECT DISTINCT wallet FROM roll7) w LEFT JOIN (SELECT * FROM base_line QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY window_days DESC) = 1) b
      ON b.wallet = w.wallet JOIN (SELECT * FROM roll7 UNION ALL SELECT * FROM roll30) c ON c.wallet = w.wallet AND c.window_days = coalesce(b.window_days, 7))"""
_SH = "(known AND (coalesce(vr >= 2 OR vr <= 0.5, false) OR coalesce(tr >= 2 OR tr <= 0.5, false) OR ar >= 2 OR lr >= 2))"


@query("w05_behavior_trend", f"""SELECT wallet, CASE WHEN {_SH} THEN 'BEHAVIORAL_SHIFT_DETECTED' WHEN known AND diff >= 5 THEN 'TREND_UP' WHEN known AND diff <= -5 THEN 'TREND_DOWN'
    ELSE 'STABLE' END AS trend, {_SH} AS shift, coalesce(nullif(array_to_string(list_filter([CASE WHEN NOT known THEN 'no_baseline_insufficient_history' END,
    CASE WHEN known THEN 'trust_score_' || (CASE WHEN diff >= 5 THEN 'up' WHEN diff <= -5 THEN 'down' ELSE 'stable' END) || '_delta=' || {_R.format(x='diff')} END,
    CASE WHEN known AND (vr >= 2 OR vr <= 0.5) THEN 'volume_ratio=' || {_R.format(x='vr')} END,
    CASE WHEN known AND (tr >= 2 OR tr <= 0.5) THEN 'tx_count_ratio=' || {_R.format(x='tr')} END,
    CASE WHEN known AND ar >= 2 THEN 'anomaly_count_ratio=' || {_R.format(x='ar')} END,
    CASE WHEN known AND lr >= 2 THEN 'alert_count_ratio=' || {_R.format(x='lr')} END], lambda x: x IS NOT NULL), ','), ''), 'first_baseline_or_stable') AS reasons FROM trend_in""")
def _(v):
    return T.behavior_trend(roll(v, 7).unionByName(roll(v, 30)), T.baseline(roll_hist(v))).withColumn(
        "reasons", F.array_join("reasons", ","))


@query("w06_inactivity_decay", f"""SELECT wallet, last_seen, round(CASE WHEN idle <= 0 THEN 1.0 WHEN idle >= 90 THEN 0.5 ELSE 1.0 - 0.5 * idle / 90 END, 6)::DOUBLE AS decay FROM (
    SELECT wallet, max(ts) AS last_seen, ({1009843200} - max(ts)) / 86400::DOUBLE AS idle FROM ends_large GROUP BY 1)""")
def _(v):
    ends = T.both_ends(v.transfers_large, "ts").groupBy("wallet").agg(F.max("ts").alias("last_seen"))
    return ends.withColumn("decay", F.round(S.inactivity_decay(F.col("last_seen"), 1009843200), 6))


_M = f"computed_at >= {AS_OF - 30 * DAY}"
SQL_VIEWS["rep_state"] = f"""SELECT wallet, cur AS current, avg_7d, avg_30d, CASE WHEN cur - coalesce(avg_30d, avg_7d) >= 3 THEN 'improving'
    WHEN cur - coalesce(avg_30d, avg_7d) <= -3 THEN 'degrading' ELSE 'stable' END AS trend, volatility, round(CASE WHEN idle <= 0 THEN 1.0 WHEN idle >= 90 THEN 0.5
    ELSE 1.0 - 0.5 * idle / 90 END * 10000) / 10000 AS decay_factor FROM (
    SELECT wallet, round(arg_max(score, (computed_at, id)) * 100) / 100 AS cur, ({AS_OF} - max(computed_at)) / 86400::DOUBLE AS idle,
      round({SUM6.format(c=f'score')} FILTER (computed_at >= {AS_OF - 7 * DAY}) / count(*) FILTER (computed_at >= {AS_OF - 7 * DAY}) * 100) / 100 AS avg_7d,
      round({SUM6.format(c='score')} / count(*) * 100) / 100 AS avg_30d, CASE WHEN count(*) >= 2 THEN round(stddev_pop(score) * 100) / 100 END AS volatility
    FROM score_timeline WHERE {_M} GROUP BY 1)""".replace("::DOUBLE FILTER", "FILTER_X").replace(
    "sum(CAST(score AS DECIMAL(28, 6)))FILTER_X (computed_at", "(sum(CAST(score AS DECIMAL(28, 6))) FILTER (computed_at").replace(
    f"{AS_OF - 7 * DAY}) / count", f"{AS_OF - 7 * DAY}))::DOUBLE / count")


@query("w07_reputation_state", "SELECT * FROM rep_state")
def _(v):
    return T.reputation_state(v.score_timeline, AS_OF)


SQL_VIEWS["ent_prev"] = f"""SELECT cluster_id AS entity_id, min(score) AS score, min(computed_at) AS last_updated FROM cluster_members JOIN latest_scores USING (wallet) GROUP BY 1"""
SQL_VIEWS["ent_rep"] = f"""SELECT *, (CASE WHEN risky > 0 THEN 'cluster_contamination' ELSE '' END) || (CASE WHEN n >= 2 THEN ';repeated_anomalies' ELSE '' END) AS tags
    FROM (SELECT *, greatest(0, least(100, round((decayed - 4.0 * n - ap - CASE WHEN members >= 2 THEN risky * 0.5 ELSE 0 END)::DOUBLE * 100) / 100))::DOUBLE AS score
    FROM (SELECT g.*, days, 50 + (coalesce(p.score, 50.0) - 50) * power(0.5, days / 90) AS decayed FROM (
      SELECT cluster_id AS entity_id, count(*) AS members, count(s.wallet) AS n, count(*) FILTER (is_anomalous) AS risky, coalesce(sum(a), 0)::DOUBLE AS ap
      FROM cluster_members m LEFT JOIN latest_scores s ON s.wallet = m.wallet LEFT JOIN (SELECT wallet, sum(CASE severity WHEN 'critical' THEN 6.0 WHEN 'high' THEN 4.0
        WHEN 'medium' THEN 2.0 ELSE 1.0 END) AS a FROM alerts WHERE created_at >= {AS_OF - 7 * DAY} GROUP BY 1) x ON x.wallet = m.wallet GROUP BY 1) g
      LEFT JOIN (SELECT *, ({AS_OF} - last_updated) / 86400::DOUBLE AS days_p FROM ent_prev) p USING (entity_id)
      CROSS JOIN LATERAL (SELECT coalesce(p.days_p, 365.0::DOUBLE) AS days)))"""


def ent_prev(v):
    return v.cluster_members.join(v.latest_scores, "wallet").groupBy(
        F.col("cluster_id").alias("entity_id")).agg(F.min("score").alias("score"), F.min("computed_at").alias("last_updated"))


def ent_rep(v):
    return T.entity_reputation(v.cluster_members, v.latest_scores, v.alerts, ent_prev(v), AS_OF)


@query("w08_entity_reputation", """SELECT entity_id, round(score, 4) AS score, tags, round(greatest(0.5, least(1, 1 - days / 90 * 0.1)), 6)::DOUBLE AS decay_factor, n AS anomaly_count,
    ap AS alert_penalty FROM ent_rep""")
def _(v):
    return ent_rep(v).select(
        "entity_id", F.round("score", 4).alias("score"),
        F.concat(F.when(F.array_contains("tags", "cluster_contamination"), "cluster_contamination").otherwise(""),
                 F.when(F.array_contains("tags", "repeated_anomalies"), ";repeated_anomalies").otherwise("")).alias("tags"),
        F.round("decay_factor", 6).alias("decay_factor"), "snapshot.anomaly_count", "snapshot.alert_penalty")


SQL_VIEWS["ent_mod"] = """SELECT s.wallet, coalesce(greatest(-10, least(10, round((e.score - 50) * 0.2 * 100) / 100)), 0)::DOUBLE AS modifier, s.score AS base
    FROM latest_scores s LEFT JOIN cluster_members m ON m.wallet = s.wallet LEFT JOIN ent_rep e ON e.entity_id = m.cluster_id"""


@query("w09_entity_modifier", """SELECT wallet, modifier, greatest(0, least(100, round((base + modifier) * 100) / 100))::DOUBLE AS score FROM ent_mod""")
def _(v):
    return T.entity_modifier(ent_rep(v), v.cluster_members, v.latest_scores)


SQL_VIEWS["ent_hist"] = """SELECT cluster_id AS entity_id, computed_at AS "at", max(score) AS score FROM score_timeline JOIN cluster_members USING (wallet) GROUP BY 1, 2"""
SQL_VIEWS["ent_ranked"] = """SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY "at" DESC, score DESC) AS rank FROM ent_hist"""


def ent_hist(v):
    return v.score_timeline.join(v.cluster_members, "wallet").groupBy(
        F.col("cluster_id").alias("entity_id"), F.col("computed_at").alias("at")).agg(F.max("score").alias("score"))


def _entity_history(v, keep=None):
    h = ent_hist(v)
    cut = AS_OF - 2 * DAY
    return T.entity_history(h.filter(F.col("at") < cut), h.filter(F.col("at") >= cut), keep=keep)


@query("w10_entity_history", 'SELECT entity_id, "at", score, rank FROM ent_ranked')
def _(v):
    return _entity_history(v)[0]


@query("w10_entity_history_newest", 'SELECT entity_id, "at", score, rank FROM ent_ranked WHERE rank <= 40')
def _(v):
    return _entity_history(v, 40)[0]


@query("w10_entity_trend", """SELECT entity_id, recent, older, CASE WHEN n < 2 THEN NULL WHEN recent > older THEN 'improving' WHEN recent < older THEN 'degrading' ELSE 'stable' END AS trend
    FROM (SELECT entity_id, arg_min(score, rank) AS recent, arg_max(score, rank) AS older, count(*) AS n FROM ent_ranked WHERE rank <= 10 GROUP BY 1)""")
def _(v):
    return _entity_history(v)[1]


SQL_VIEWS["new_alerts"] = f"""SELECT DISTINCT wallet, severity, reason FROM (
    SELECT wallet, 'risk_score' AS severity, 'Trust score below threshold: ' || round(CAST(score AS DECIMAL(12, 4)), 1)::DECIMAL(12, 1) || ' < 50.0' AS reason FROM latest_scores WHERE score < 50
    UNION ALL SELECT wallet, severity, message FROM flag_rows)"""


@query("w11_alerts", f"""SELECT wallet, severity, reason, {AS_OF} AS created_at FROM new_alerts WHERE wallet NOT IN (FROM scam_wallets)""")
def _(v):
    first = A.alerts(v.latest_scores, test_flags(v), v.alerts.filter("false"), AS_OF - 1800)
    repeat = first.join(v.scam_wallets, "wallet", "left_semi")
    return A.alerts(v.latest_scores, test_flags(v), repeat, AS_OF)


def observations(v):
    """One observation per wallet and six hours: error events count as burst, large ones also as velocity."""
    t = v.transfers.withColumn("ts", (F.floor(F.col("ts") / 21_600) + 1) * 21_600)
    kind = F.array_compact(F.array(
        F.when(F.col("err").isNotNull(), F.lit("burst_transactions")),
        F.when(F.col("err").isNotNull() & (F.col("amount_lamports") >= 80_000_000_000), F.lit("suspicious_velocity"))))
    return t.groupBy("wallet", "ts").agg(F.array_distinct(F.flatten(F.collect_set(kind))).alias("types"))


SQL_VIEWS["esc_obs"] = """SELECT wallet, (ts // 21600 + 1) * 21600 AS ts, bool_or(err IS NOT NULL) AS b, bool_or(err IS NOT NULL AND amount_lamports >= 80000000000) AS q
    FROM transfers GROUP BY 1, 2"""
SQL_VIEWS["esc_ctx"] = """SELECT o.wallet, o.ts, row_number() OVER (PARTITION BY o.wallet ORDER BY o.ts) AS rn, b::INTEGER + q::INTEGER AS n, count(a.wallet) > 0 AS recent,
    b AND count(a.wallet) > 0 AS rep, (b OR count(a.wallet) > 0)::INTEGER + q::INTEGER >= 2 AS multi, count(a.wallet) FILTER (a.created_at >= o.ts - 3600) >= 3 AS clu
    FROM esc_obs o LEFT JOIN alerts a ON a.wallet = o.wallet AND a.created_at BETWEEN o.ts - 172800 AND o.ts GROUP BY o.wallet, o.ts, b, q"""
SQL_VIEWS["esc_walk"] = """SELECT wallet, 0::BIGINT AS rn, 0.0::DOUBLE AS score, NULL::BIGINT AS last_alert_ts, min(ts) AS last_clean_ts, NULL::BIGINT AS ts, false AS rep, false AS multi, false AS clu
      FROM esc_ctx GROUP BY 1 UNION ALL
    SELECT c.wallet, c.rn, CASE WHEN c.n = 0 AND NOT recent THEN CASE WHEN c.ts - last_clean_ts >= 172800 THEN 0.0 WHEN c.ts - last_alert_ts >= 86400 THEN greatest(0.0, score - 12) ELSE score END
        ELSE least(100.0, CASE WHEN c.n = 0 AND c.ts - last_clean_ts >= 86400 THEN greatest(0.0, score - 12) ELSE score END
          + 6 * c.n + CASE WHEN c.rep THEN 8 ELSE 0 END + CASE WHEN c.multi THEN 12 ELSE 0 END + CASE WHEN c.clu THEN 15 ELSE 0 END) END,
      CASE WHEN c.n > 0 THEN c.ts WHEN NOT recent AND c.ts - last_clean_ts >= 172800 THEN NULL ELSE last_alert_ts END,
      CASE WHEN c.n = 0 AND NOT recent THEN c.ts ELSE last_clean_ts END, c.ts, c.rep, c.multi, c.clu
    FROM esc_walk w JOIN esc_ctx c ON c.wallet = w.wallet AND c.rn = w.rn + 1"""
SQL_VIEWS["esc_end"] = """SELECT *, CASE stage WHEN 'warning' THEN 'watchlist' ELSE stage END AS tier FROM (
    SELECT wallet, ts, round(score * 100) / 100 AS score, CASE WHEN score <= 30 THEN 'normal' WHEN score <= 60 THEN 'warning' ELSE 'critical' END AS stage, last_alert_ts, last_clean_ts, rep, multi, clu
    FROM esc_walk WHERE rn > 0 QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY rn DESC) = 1)"""


@query("w12_escalation_state", """SELECT wallet, stage, score, tier, last_alert_ts, last_clean_ts,
    array_to_string(list_filter([CASE WHEN rep THEN 'repeated' END, CASE WHEN multi THEN 'multiple_types' END, CASE WHEN clu THEN 'time_cluster' END], lambda x: x IS NOT NULL), ',') AS reasons FROM esc_end""")
def _(v):
    return A.escalation_state(observations(v), v.alerts).withColumn("reasons", F.array_join("reasons", ","))


@query("w13_score_snapshot", f"""SELECT wallet, {AS_OF} AS ts, coalesce(score, 50.0) AS score, CASE WHEN is_anomalous THEN 2 ELSE 1 END AS risk FROM wallets LEFT JOIN latest_scores USING (wallet)
    WHERE wallet NOT IN (FROM scam_wallets)""")
def _(v):
    s = v.wallets.join(v.latest_scores, "wallet", "left").withColumn("risk", F.when(F.col("is_anomalous"), 2))
    done = v.scam_wallets.withColumn("ts", F.lit(AS_OF).cast("bigint"))
    return T.score_snapshot(s, AS_OF, done)


@query("w14_score_change_30d", f"""SELECT s.wallet, round((s.score - o.old) * 10) / 10 AS change FROM latest_scores s LEFT JOIN (
    SELECT wallet, arg_max(score, (computed_at, id)) AS old FROM score_timeline WHERE computed_at <= {AS_OF - 29 * DAY} GROUP BY 1) o ON o.wallet = s.wallet""")
def _(v):
    h = v.score_timeline.withColumnRenamed("computed_at", "snapshot_at").withColumn("posterior", F.lit(None).cast("double"))
    return T.score_change_30d(v.latest_scores, h, AS_OF + DAY)


SQL_VIEWS["prev_sc"] = """SELECT wallet, score AS prev_score, computed_at AS prev_ts FROM score_timeline
    QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY computed_at DESC, id DESC) = 2"""


@query("w15_previous_score", "SELECT * FROM prev_sc")
def _(v):
    return T.previous_score(v.score_timeline)


SQL_VIEWS["queue_old"] = "SELECT wallet FROM latest_scores WHERE score < 60"
SQL_VIEWS["reviews"] = f"""SELECT wallet, score, confidence, CASE WHEN score < 30 THEN 1 WHEN score < 60 THEN 2 ELSE 3 END AS risk, hint, {AS_OF} AS created_at, 'pending' AS status FROM (
    SELECT s.wallet, score, confidence, CASE WHEN score < 20 AND confidence < 0.7 THEN 'low_score_low_confidence'
      WHEN {AS_OF} - prev_ts <= {DAY} AND abs(score - prev_score) > 40 THEN 'score_spike' WHEN scam AND s.wallet NOT IN (FROM queue_old) THEN 'new_scam_reason'
      WHEN size BETWEEN 1 AND 4 AND scam THEN 'small_cluster_scam' END AS hint
    FROM (SELECT wallet, score, CASE WHEN is_anomalous THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM latest_scores) s LEFT JOIN prev_sc USING (wallet)
    LEFT JOIN (SELECT wallet, bool_or(reason_code IN {sql_set(P.SUSPICIOUS_CODES)}) AS scam FROM wallet_reasons GROUP BY 1) USING (wallet)
    LEFT JOIN (SELECT wallet, count(*) OVER (PARTITION BY cluster_id) AS size FROM cluster_members) USING (wallet)) WHERE hint IS NOT NULL"""


def reviews(v):
    s = v.latest_scores.withColumn("confidence", F.when(F.col("is_anomalous"), 0.5).otherwise(0.9))
    sizes = v.cluster_members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return T.review_triggers(
        s, v.wallet_reasons, v.score_timeline,
        v.cluster_members.join(sizes, "cluster_id"), v.latest_scores.filter("score < 60"), AS_OF)


@query("w16_review_triggers", "SELECT * FROM reviews")
def _(v):
    return reviews(v)


@query("w17_review_status", """SELECT wallet, hint, CASE WHEN wallet IN (FROM scam_wallets) THEN 'rejected' WHEN risk = 3 THEN 'approved' ELSE status END AS status FROM reviews""")
def _(v):
    q = reviews(v)
    d = q.filter("risk = 3").select("wallet", F.lit("approved").alias("decision"), F.lit(1).alias("decided_at")).union(
        v.scam_wallets.select("wallet", F.lit("rejected"), F.lit(2)))
    return T.review_status(q, d).select("wallet", "hint", "status")


@query("w17_pending_reviews", "SELECT wallet, hint FROM reviews ORDER BY created_at DESC, wallet LIMIT 10")
def _(v):
    return T.pending_reviews(reviews(v), 10).select("wallet", "hint")


@query("w18_activity_heatmap", """SELECT wallet, CAST(extract(dow FROM make_timestamp(ts * 1000000)) AS INTEGER) AS day, CAST(extract(hour FROM make_timestamp(ts * 1000000)) AS INTEGER) AS hour,
    count(*) AS tx_count FROM ends GROUP BY 1, 2, 3""")
def _(v):
    return T.activity_heatmap(v.transfers)


@query("w19_daily_activity", f"""SELECT wallet, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS "date", count(*) AS tx FROM ends WHERE ts >= {AS_OF - 30 * DAY} GROUP BY 1, 2""")
def _(v):
    return T.daily_activity(v.transfers, AS_OF)


@query("w20_needs_refresh", """SELECT w.wallet, s.wallet IS NOT NULL AS cached, s.wallet IS NULL OR coalesce(mx > s.computed_at, false) AS needs_refresh, s.computed_at AS last_updated
    FROM (SELECT DISTINCT wallet FROM ends) w LEFT JOIN latest_scores s USING (wallet) LEFT JOIN (SELECT wallet, max(ts) AS mx FROM ends GROUP BY 1) USING (wallet)""")
def _(v):
    wallets = v.transfers.select(F.explode(F.array("sender", "receiver")).alias("wallet")).distinct()
    return T.needs_refresh(v.latest_scores.withColumnRenamed("computed_at", "last_updated"), v.transfers, wallets)


@query("w21_risk_timeline", """SELECT wallet, row_number() OVER (PARTITION BY wallet ORDER BY created_at, tx_hash, reason_code) AS position, created_at, reason_code, weight, confidence, tx_hash
    FROM wallet_reasons""")
def _(v):
    return T.risk_timeline(v.wallet_reasons)


SQL_VIEWS["re_tab"] = constant_view("code, text", P.REASON_EVENTS)
SQL_VIEWS["rr_tab"] = constant_view("code, lvl", P.REASON_EVENT_RISK)


@query("w22_event_timeline", """WITH t AS (SELECT wallet, min(ts) AS f, count(*) AS n FROM ends GROUP BY 1), c AS (SELECT m.wallet, s.computed_at AS d, count(*) OVER (PARTITION BY cluster_id) AS size
      FROM cluster_members m LEFT JOIN latest_scores s USING (wallet))
    SELECT wallet, d AS "date", e AS event, ty AS type, lv AS risk_level, CASE lv WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS severity FROM (
    SELECT wallet, computed_at AS d, 'Activity snapshot recorded' AS e, 'activity' AS ty, 'LOW' AS lv FROM score_timeline
    UNION ALL SELECT wallet, created_at, coalesce(text, 'High Value Outflow'), CASE WHEN regexp_matches(reason_code, 'SCAM|DRAINER|RISKY|BLACKLIST|RUG') THEN 'risk' ELSE 'info' END,
      coalesce(lvl, 'LOW') FROM wallet_reasons LEFT JOIN re_tab a ON a.code = reason_code LEFT JOIN rr_tab b ON b.code = reason_code
    UNION ALL SELECT wallet, f, 'First transaction detected', 'milestone', 'LOW' FROM t
    UNION ALL SELECT wallet, f, 'Wallet became active (10+ transactions)', 'milestone', 'LOW' FROM t WHERE n >= 10
    UNION ALL SELECT wallet, f, 'High activity wallet detected (100+ transactions)', 'milestone', 'LOW' FROM t WHERE n >= 100
    UNION ALL SELECT wallet, d, 'Wallet linked to risk cluster', 'propagation', 'HIGH' FROM c WHERE size > 3
    UNION ALL SELECT wallet, d, 'Risk propagated across network cluster', 'propagation', 'CRITICAL' FROM c WHERE size > 10
    UNION ALL SELECT wallet, min(computed_at), 'First activity detected', 'activity', 'LOW' FROM score_timeline GROUP BY 1)""")
def _(v):
    h = v.score_timeline.withColumnRenamed("computed_at", "snapshot_at")
    return T.event_timeline(h, v.wallet_reasons, v.transfers, v.cluster_members, v.latest_scores)


@query("w23_top_risky", "SELECT wallet, score FROM latest_scores ORDER BY score, wallet LIMIT 10")
def _(v):
    return T.top_risky(v.score_timeline)
