"""Usage, operations and data-quality queries."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import AS_OF, DAY, SQL_VIEWS
from ledgerwise.functions import scores as S
from ledgerwise.operators import ops as O

NOW = AS_OF - DAY  # inside the event month
SQL_VIEWS["hourly"] = """SELECT api_key, endpoint, ts // 3600 * 3600 AS hour, count(*) AS requests, count(*) FILTER (status < 400) AS success, count(*) FILTER (status >= 400) AS errors,
    sum(CAST(response_ms AS DECIMAL(28, 6)))::DOUBLE / count(*) AS avg_ms FROM usage_events GROUP BY 1, 2, 3"""
SQL_VIEWS["api_keys"] = "SELECT DISTINCT api_key, 'user-' || right(api_key, 1) AS \"user\", CAST(right(api_key, 1) AS INTEGER) * 300 AS quota_limit FROM usage_events"


def keys(v):
    d = F.substring("api_key", -1, 1)
    return v.usage_events.select("api_key", F.concat(F.lit("user-"), d).alias("user"), (d.cast("int") * 300).alias("quota_limit")).distinct()


def hourly(v):
    return O.usage_hourly(v.usage_events)


@query("u01_usage_hourly", "SELECT * REPLACE (round(avg_ms, 6) AS avg_ms) FROM hourly")
def _(v):
    return hourly(v).withColumn("avg_ms", F.round("avg_ms", 6))


@query("u01_usage_hourly_merge", "SELECT * REPLACE (round(avg_ms, 4) AS avg_ms) FROM hourly")
def _(v):
    cut = AS_OF - 10 * DAY + 1800
    old = O.usage_hourly(v.usage_events.filter(F.col("ts") < cut))
    return O.usage_hourly(v.usage_events.filter(F.col("ts") >= cut), old).withColumn("avg_ms", F.round("avg_ms", 4))


_MS = "round(sum(CAST(avg_ms * requests AS DECIMAL(28, 6)))::DOUBLE / sum(requests)::DOUBLE * 10) / 10"


@query("u02_usage_summary", f"""SELECT k."user", "limit", coalesce(used, 0) AS used, coalesce(success, 0) AS success, coalesce(errors, 0) AS errors, coalesce(avg_ms, 0) AS avg_ms,
    CASE WHEN "limit" > 0 THEN round(coalesce(used, 0) * 100::DOUBLE / "limit" * 10) / 10 ELSE 0 END::DOUBLE AS pct FROM (SELECT "user", max(quota_limit) AS "limit" FROM api_keys GROUP BY 1) k
    LEFT JOIN (SELECT "user", CAST(sum(requests) AS BIGINT) AS used, CAST(sum(success) AS BIGINT) AS success, CAST(sum(errors) AS BIGINT) AS errors, {_MS} AS avg_ms FROM hourly JOIN api_keys USING (api_key)
      WHERE hour >= epoch(date_trunc('month', make_timestamp({NOW}::BIGINT * 1000000))) AND hour < epoch(date_trunc('month', make_timestamp({NOW}::BIGINT * 1000000)) + INTERVAL 1 MONTH) GROUP BY 1) u ON u."user" = k."user" """)
def _(v):
    return O.usage_summary(hourly(v), keys(v), NOW)


SQL_VIEWS["recent_u"] = f"""SELECT h.*, "user" FROM hourly h JOIN api_keys USING (api_key) WHERE hour >= {AS_OF - 7 * DAY}"""
_TOT = "CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(success) AS BIGINT) AS success, CAST(sum(errors) AS BIGINT) AS errors"


@query("u03_usage_daily", f"""SELECT "user", strftime(make_timestamp(hour * 1000000), '%Y-%m-%d') AS "date", {_TOT} FROM recent_u GROUP BY 1, 2""")
def _(v):
    return O.usage_daily(hourly(v), keys(v), AS_OF, 7)


@query("u03_usage_by_endpoint", f"""SELECT "user", CASE WHEN endpoint = 'view' THEN 'unknown' ELSE endpoint END AS endpoint, {_TOT}, {_MS} AS avg_ms FROM recent_u GROUP BY 1, 2""")
def _(v):
    h = hourly(v).withColumn("endpoint", F.nullif("endpoint", F.lit("view")))
    return O.usage_by_endpoint(h, keys(v), AS_OF, 7)


@query("u03_usage_by_status", """SELECT "user", 'success' AS status, CAST(sum(success) AS BIGINT) AS "count" FROM recent_u GROUP BY 1 UNION ALL SELECT "user", 'errors', CAST(sum(errors) AS BIGINT) FROM recent_u GROUP BY 1""")
def _(v):
    return O.usage_by_status(hourly(v), keys(v), AS_OF, 7)


@query("u04_quota_check", """SELECT api_key, lim < 0 OR used + 5 <= lim AS allowed, CASE WHEN lim < 0 THEN -1 ELSE greatest(0, lim - used) END AS remaining FROM (
    SELECT api_key, count(*) AS used, CASE WHEN any_value(right(api_key, 1)) = '0' THEN -1 ELSE 70 END AS lim FROM usage_events GROUP BY 1)""")
def _(v):
    g = v.usage_events.groupBy("api_key").agg(F.count(F.lit(1)).alias("used"))
    limit = F.when(F.col("api_key").endswith("0"), -1).otherwise(70)
    q = S.quota_check(F.col("used"), limit, F.lit(5))
    return g.select("api_key", q["allowed"].alias("allowed"), q["remaining"].alias("remaining"))


def calls(v):
    return v.transfers.select("wallet", F.length("signature").alias("calls"), "ts")


SQL_VIEWS["today_calls"] = f"SELECT wallet, length(signature) AS calls FROM transfers WHERE ts >= {NOW // DAY * DAY} AND ts < {NOW // DAY * DAY + DAY}"


@query("u05_api_cost", """SELECT calls, round(calls * 0.00001::DOUBLE, 9) AS cost, round(calls * 0.00001::DOUBLE * 30, 9) AS monthly, calls * 0.00001::DOUBLE > 0.01 AS over_budget FROM (SELECT CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls FROM today_calls)""")
def _(v):
    return O.api_cost(calls(v), NOW, 0.01)[0].withColumns({"cost": F.round("cost", 9), "monthly": F.round("monthly", 9)})


@query("u05_api_cost_top", "SELECT wallet, CAST(sum(calls) AS BIGINT) AS calls, round(sum(calls) * 0.00001::DOUBLE, 9) AS cost FROM today_calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(v):
    return O.api_cost(calls(v), NOW, 0.01)[1].withColumn("cost", F.round("cost", 9))


SQL_VIEWS["stage_recent"] = f"SELECT * FROM stage_log WHERE ts BETWEEN {NOW - DAY} AND {NOW}"


@query("u06_stage_health", """SELECT stage, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS error, round(count(*) FILTER (status = 'ok') / count(*)::DOUBLE * 10000) / 10000 AS success_rate,
    round(sum(CAST(latency_ms AS DECIMAL(28, 6)))::DOUBLE / count(*)::DOUBLE * 100) / 100 AS avg_latency_ms FROM stage_recent GROUP BY 1""")
def _(v):
    return O.stage_health(v.stage_log, NOW)[0]


@query("u06_stage_errors", "SELECT ts, stage, message, wallet FROM stage_recent WHERE status = 'error'")
def _(v):
    return O.stage_health(v.stage_log, NOW)[1]


@query("u06_stage_errors_newest", "SELECT ts, stage, message, wallet FROM stage_recent WHERE status = 'error' ORDER BY ts DESC, message LIMIT 20")
def _(v):
    return O.stage_health(v.stage_log, NOW, 20)[1]


def runs(v):
    """One run per day: failed when more than a fifth of its steps failed."""
    return v.stage_log.groupBy(F.floor(F.col("ts") / DAY).alias("run_id")).agg(
        F.min("ts").alias("started_at"), (F.count_if(F.col("status") == "error") * 5 <= F.count(F.lit(1))).alias("success"),
        F.count_distinct("wallet").alias("wallets"))


SQL_VIEWS["runs"] = f"SELECT ts // {DAY} AS run_id, min(ts) AS started_at, count(*) FILTER (status = 'error') * 5 <= count(*) AS success, count(DISTINCT wallet) AS wallets FROM stage_log GROUP BY 1"


@query("u07_run_summary", """SELECT count(*) AS runs, count(*) FILTER (NOT success) AS failures, CAST(sum(wallets) AS BIGINT) AS wallets, arg_max(run_id, started_at) AS latest_run, arg_max(success, started_at) AS latest_success FROM runs""")
def _(v):
    return O.run_summary(runs(v))


@query("u08_trust_stats", f"""SELECT round(sum(CAST(score AS DECIMAL(28, 6)))::DOUBLE / count(*)::DOUBLE * 100) / 100 AS avg_score, count(*) AS scored, count(*) FILTER (score < 40) AS high_risk,
    (SELECT count(*) FROM alerts WHERE created_at >= {NOW // DAY * DAY}) AS new_scam_today FROM latest_scores""")
def _(v):
    return O.trust_stats(v.latest_scores, v.alerts.withColumnRenamed("created_at", "detected_at"), NOW)


@query("u09_ops_alerts", """SELECT 'helius_cost' AS type, printf('Helius cost $%.2f exceeds limit $0.01', calls * 0.00001::DOUBLE) AS message, 'high' AS severity FROM (SELECT sum(calls) AS calls FROM today_calls) WHERE calls * 0.00001 > 0.01
    UNION ALL SELECT 'pipeline_failed', 'Last pipeline run failed', 'high' FROM (SELECT arg_max(success, started_at) AS s FROM runs) WHERE NOT s
    UNION ALL SELECT 'review_queue', 'Review queue (' || n || ') exceeds threshold (10)', 'medium' FROM (SELECT count(*) AS n FROM latest_scores WHERE score < 60) WHERE n > 10""")
def _(v):
    q = v.latest_scores.filter("score < 60").withColumn("status", F.lit("pending"))
    return O.ops_alerts(O.api_cost(calls(v), NOW, 0.01)[0], runs(v), q, 0.01, 10)


@query("u10_integrity_checks", f"""SELECT "check", violations = 0 AS ok, violations FROM (VALUES
    ('null_wallets_transfers', (SELECT count(*) FROM transfers WHERE program_id = 'view')), ('null_wallets_scores', 0), ('null_wallets_reasons', 0),
    ('duplicate_scores', (SELECT count(*) FROM (SELECT wallet FROM score_timeline GROUP BY 1 HAVING count(*) > 1))),
    ('timestamp_range', (SELECT count(*) FROM score_timeline WHERE computed_at > {AS_OF - 9 * DAY})),
    ('empty_clusters', (SELECT count(DISTINCT k) FROM ev WHERE k NOT IN (SELECT cluster_id FROM cluster_members))),
    ('score_range', (SELECT count(*) FROM score_timeline WHERE score - 20 < 0)),
    ('duplicate_reasons', 0), ('reasons_without_score', (SELECT count(DISTINCT wallet) FROM wallet_reasons WHERE wallet NOT IN (SELECT wallet FROM score_timeline))),
    ('scores_without_reasons', 0), ('bad_links', (SELECT count(*) FROM wallet_reasons WHERE reason_code = 'CLEAN_HISTORY')), ('has_positives', (SELECT (count(*) = 0)::BIGINT FROM wallet_reasons WHERE weight > 0))) AS t("check", violations)""")
def _(v):
    t = v.transfers.withColumn("wallet", F.when(F.col("program_id") != "view", F.col("wallet")))
    s = v.score_timeline.withColumn("score", F.col("score") - 20)
    r = v.wallet_reasons.withColumn("tx_link", F.when(F.col("reason_code") == "CLEAN_HISTORY", "http://x").otherwise("https://x"))
    return O.integrity_checks(t, s, r, v.score_timeline.withColumnRenamed("computed_at", "snapshot_at"), v.cluster_members,
                              v.ev.select(F.col("k").alias("cluster_id")).distinct(), AS_OF - 9 * DAY)


@query("u11_score_reconciliation", """SELECT count(*) FILTER (l = r) AS matches, count(*) FILTER (l <> r) AS mismatches, count(*) FILTER (l IS NULL OR r IS NULL) AS missing,
    round(count(*) FILTER (l = r) / count(*)::DOUBLE * 10000) / 10000 AS rate FROM (SELECT a.score AS l, b.score AS r FROM latest_scores a FULL JOIN (SELECT wallet, max(score) AS score FROM score_timeline GROUP BY 1) b ON b.wallet = a.wallet)""")
def _(v):
    right = v.score_timeline.groupBy("wallet").agg(F.max("score").alias("score"))
    return O.score_reconciliation(v.latest_scores, right)
