"""Priority queries."""

from pyspark.sql import functions as F

from catalog.reasons import sql_set
from catalog.registry import query
from catalog.views import AS_OF, DAY, SQL_VIEWS
from ledgerwise import params as P
from ledgerwise.operators import graph as G
from ledgerwise.operators import priority as R

H = 3600


def scans(v):
    return v.tracked_wallets.filter("last_scan_ts IS NOT NULL").select("wallet", "last_scan_ts")


@query("p01_scan_priority", f"""WITH sc AS (SELECT wallet, last_scan_ts FROM tracked_wallets WHERE last_scan_ts IS NOT NULL),
    bad AS (SELECT DISTINCT cluster_id FROM cluster_members WHERE wallet IN (FROM scam_wallets)),
    x AS (SELECT w.wallet, w.wallet IN (SELECT wallet FROM wallet_reasons WHERE reason_code IN {sql_set(P.HIGH_RISK_CODES)} AND created_at >= {AS_OF - 7 * DAY}) AS sus,
      s.score, s.wallet IS NOT NULL AS has, m.cluster_id IN (FROM bad) AS clu, coalesce(n, 0) AS n, max(coalesce(n, 0)) OVER () AS mx, last_scan_ts, sc.wallet IS NOT NULL AS scanned,
      ({AS_OF} - last_scan_ts) // {DAY} AS days FROM wallets w LEFT JOIN latest_scores s ON s.wallet = w.wallet
      LEFT JOIN cluster_members m ON m.wallet = w.wallet LEFT JOIN (SELECT wallet, count(*) AS n FROM transfers GROUP BY 1) t ON t.wallet = w.wallet LEFT JOIN sc ON sc.wallet = w.wallet)
    SELECT wallet, round(0.3 * sus::INT + CASE WHEN has THEN 0.2 * greatest(0, 1 - score / 100) ELSE 0 END + 0.2 * coalesce(clu, false)::INT + 0.1 * n / mx::DOUBLE
      + 0.1 * CASE WHEN scanned THEN least(1.0, days / 30.0) ELSE 1 END, 9)::DOUBLE AS priority,
      CASE WHEN sus THEN 'recent_suspicious' WHEN has AND score < 40 THEN 'low_trust_score' WHEN clu THEN 'recent_scam_cluster' WHEN n > 100 THEN 'high_tx_volume'
      WHEN scanned AND days > 7 THEN 'not_scanned_recently' WHEN NOT scanned THEN 'never_scanned' ELSE 'default' END AS reason FROM x ORDER BY 2 DESC, 1 LIMIT 60""")
def _(v):
    return R.scan_priority(v.wallets, v.wallet_reasons, v.latest_scores, v.cluster_members, v.scam_wallets, v.transfers, scans(v), AS_OF,
                           60).withColumn("priority", F.round("priority", 9))


@query("p02_ordered_union", f"""SELECT wallet, min(rank) AS rank FROM (SELECT wallet, 1 AS rank FROM scam_wallets UNION ALL
    SELECT sender, 2 FROM transfers GROUP BY 1 HAVING min(ts) >= {AS_OF - 30 * DAY + 2 * H} UNION ALL SELECT wallet, 3 FROM transfers WHERE ts >= {AS_OF - DAY}
    UNION ALL SELECT wallet, 4 FROM tracked_wallets WHERE last_scan_ts < {AS_OF - 2 * DAY}) GROUP BY 1""")
def _(v):
    first = v.transfers.groupBy("wallet").agg((F.min("ts") + 23 * DAY - 2 * H).alias("first_tx_ts"))
    late = scans(v).withColumn("last_scan_ts", F.col("last_scan_ts") - 28 * DAY)
    return R.ordered_union(v.scam_wallets, first, v.transfers, late, AS_OF)


@query("p03_seed_priorities", f"""WITH h AS (SELECT wallet, min(h) AS h FROM (SELECT neighbor AS wallet, 1 AS h FROM adj_six WHERE wallet IN (FROM scam_six_hour)
      UNION ALL SELECT y.neighbor, 2 FROM adj_six x JOIN adj_six y ON y.wallet = x.neighbor WHERE x.wallet IN (FROM scam_six_hour)) GROUP BY 1)
    SELECT wallet, priority, reason, hop FROM (SELECT wallet, 100 AS priority, 'SCAM' AS reason, 0 AS hop FROM scam_six_hour
      UNION ALL SELECT wallet, 70, 'CLUSTER_1HOP', 1 FROM h WHERE h = 1 UNION ALL SELECT wallet, 60, 'CLUSTER_2HOP', 2 FROM h WHERE h = 2
      UNION ALL SELECT sender, 80, 'NEW_WALLET', 0 FROM transfers_six_hour GROUP BY sender HAVING min(ts) >= {AS_OF - 3 * DAY}
      UNION ALL SELECT w, 50, 'ACTIVE', 0 FROM (SELECT sender AS w FROM transfers UNION ALL SELECT receiver FROM transfers) GROUP BY w HAVING count(*) > 50)
    QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY priority DESC) = 1""")
def _(v):
    t = v.transfers_six_hour
    meta = t.groupBy(F.col("sender").alias("wallet")).agg(F.min("ts").alias("first_tx_ts")).withColumn(
        "wallet_age_days", F.lit(None).cast("bigint"))
    return R.seed_priorities(v.scam_six_hour, G.transfer_edges(t), meta, v.transfers, None, AS_OF)


SQL_VIEWS["prios"] = f"""SELECT wallet, CASE tier WHEN 'critical' THEN 90 WHEN 'watchlist' THEN 60 ELSE 30 END AS priority, last_scan_ts AS last_checked FROM tracked_wallets"""


def prios(v):
    p = F.when(F.col("tier") == "critical", 90).when(F.col("tier") == "watchlist", 60).otherwise(30)
    return v.tracked_wallets.select("wallet", p.alias("priority"), F.col("last_scan_ts").alias("last_checked"))


@query("p04_age_priorities", f"""SELECT wallet, CASE WHEN last_checked IS NULL THEN priority ELSE CAST(greatest(0, least(100, priority - 2 * d - CASE WHEN d > 30 THEN 20 ELSE 0 END)) AS INTEGER) END AS priority, last_checked
    FROM (SELECT *, ({AS_OF + 28 * DAY + 12 * H} - last_checked) // {DAY} AS d FROM prios)""")
def _(v):
    return R.age_priorities(prios(v), AS_OF + 28 * DAY + 12 * H)


@query("p05_boost_active", f"""SELECT p.wallet, CAST(least(100, priority + 2 * coalesce(n, 0)) AS INTEGER) AS priority, last_checked, last_tx_time, coalesce(n, 0) AS tx_count_24h FROM prios p LEFT JOIN (
    SELECT wallet, max(ts) AS last_tx_time, count(*) FILTER (ts > {AS_OF - DAY}) AS n FROM ends GROUP BY 1) USING (wallet)""")
def _(v):
    return R.boost_active(prios(v), v.transfers, AS_OF)


@query("p06_expire_priorities", f"""SELECT p.wallet, CAST(greatest(0, least(100, priority + coalesce(d, 0))) AS INTEGER) AS priority, last_checked FROM prios p LEFT JOIN (
    SELECT wallet, count(*) - 20 AS d FROM alerts GROUP BY 1) USING (wallet) WHERE last_checked IS NULL OR last_checked >= {AS_OF - 3 * DAY}""")
def _(v):
    d = v.alerts.groupBy("wallet").agg((F.count(F.lit(1)) - 20).alias("delta"))
    return R.expire_priorities(prios(v), AS_OF, 3, d)


@query("p07_select_with_budget", "SELECT wallet FROM prios ORDER BY priority DESC, last_checked ASC NULLS FIRST, wallet LIMIT 25")
def _(v):
    return R.select_with_budget(prios(v), 100, 25)


@query("p08_tiered_batch", f"""WITH l AS (SELECT s.*, (SELECT CASE max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 ELSE 1 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' END
      FROM alerts a WHERE a.wallet = s.wallet AND a.created_at >= {AS_OF - 2 * DAY}) AS sev FROM latest_scores s),
    x AS (SELECT t.wallet, tier, CASE tier WHEN 'critical' THEN 3 WHEN 'watchlist' THEN 2 ELSE 1 END AS rk, computed_at, CASE
      WHEN sev IN ('critical', 'high') THEN 1100 - score WHEN score < 40 THEN 840 - score WHEN is_anomalous AND sev IS NOT NULL THEN 600 WHEN l.wallet IS NULL THEN 500
      WHEN {AS_OF} - f <= {7 * DAY} THEN 499 ELSE 300 - least(100, score) END::DOUBLE AS priority, CASE WHEN sev IN ('critical', 'high') THEN 'escalation_severe_anomaly' WHEN score < 40 THEN 'high_risk_low_score'
      WHEN is_anomalous AND sev IS NOT NULL THEN 'recent_anomaly' WHEN l.wallet IS NULL THEN 'new_no_score' WHEN {AS_OF} - f <= {7 * DAY} THEN 'new_recent_first_seen' ELSE 'normal' END AS reason
      FROM tracked_wallets t LEFT JOIN l ON l.wallet = t.wallet LEFT JOIN (SELECT wallet, min(ts) + {23 * DAY - 2 * H} AS f FROM transfers GROUP BY 1) p ON p.wallet = t.wallet)
    SELECT wallet, tier, priority, reason FROM x ORDER BY rk DESC, priority DESC, coalesce(computed_at, 0), wallet LIMIT 100""")
def _(v):
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2).otherwise(1)
    sev = v.alerts.filter(F.col("created_at") >= AS_OF - 2 * DAY).groupBy("wallet").agg(F.max(rank).alias("r"))
    latest = v.latest_scores.join(sev, "wallet", "left").withColumn(
        "max_severity", F.when(F.col("r") == 3, "critical").when(F.col("r") == 2, "high").when(F.col("r") == 1, "medium"))
    prof = v.transfers.groupBy("wallet").agg((F.min("ts") + 23 * DAY - 2 * H).alias("first_seen_at"))
    return R.tiered_batch(v.tracked_wallets, latest, prof, AS_OF, 100)


_CYCLE = """SELECT wallet, tier FROM tracked_wallets WHERE tier = 'critical' OR ({w} AND tier = 'watchlist' AND coalesce({a} - last_scan_ts, 999999) >= 60)
    OR ({n} AND tier = 'normal' AND coalesce({a} - last_scan_ts, 999999) >= 120)"""
for _cycle in (1, 2, 4):
    query(f"p09_cycle_selection_{_cycle}", _CYCLE.format(w=str(_cycle % 2 == 0), n=str(_cycle % 4 == 0), a=AS_OF - 2 * DAY))(
        lambda v, c=_cycle: R.cycle_selection(v.tracked_wallets.withColumnRenamed("last_scan_ts", "last_analyzed_at"), c, AS_OF - 2 * DAY))
