"""Report queries."""

from pyspark.sql import functions as F

from catalog.features import test_flags
from catalog.graph import D
from catalog.reasons import BADGE5, effective, sql_set, unique
from catalog.registry import constant_view, query
from catalog.timeseries import _entity_history, ent_rep
from catalog.views import AS_OF, DAY, SQL_VIEWS
from ledgerwise import params as P
from ledgerwise.functions import scores as S
from ledgerwise.operators import propagation as R
from ledgerwise.operators import reports as Q
from ledgerwise.operators import scoring as C
from ledgerwise.operators import timeseries as T


def partial_scores(v):
    """All scores there are: those of senders, so that defaults show for wallets that only receive."""
    return v.latest_scores


SQL_VIEWS["p_scores"] = "SELECT * FROM latest_scores"
SQL_VIEWS["all_w"] = "SELECT DISTINCT wallet FROM ends"
SQL_VIEWS["c_size"] = "SELECT wallet, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM cluster_members"
SQL_VIEWS["profile"] = """SELECT w.wallet, coalesce(score, 50.0) AS trust_score, CASE WHEN coalesce(score, 50) >= 80 THEN 'LOW' WHEN coalesce(score, 50) >= 50 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
    cluster_id, coalesce(cluster_size, 0) AS cluster_size, degree, total_transactions, volume_lamports, coalesce(reason_count, 0) AS reason_count, latest_reason
    FROM all_w w LEFT JOIN p_scores s USING (wallet) LEFT JOIN c_size USING (wallet)
    LEFT JOIN (SELECT wallet, count(DISTINCT counterparty) AS degree, count(*) AS total_transactions, CAST(sum(amount_lamports) AS BIGINT) AS volume_lamports FROM ends GROUP BY 1) USING (wallet)
    LEFT JOIN (SELECT wallet, count(*) AS reason_count, arg_max(reason_code, (created_at, tx_hash)) AS latest_reason FROM wallet_reasons GROUP BY 1) USING (wallet)"""


@query("q01_identity_profile", "SELECT * FROM profile")
def _(v):
    return Q.identity_profile(partial_scores(v), v.cluster_members, v.transfers, v.wallet_reasons)


@query("q02_identity_activity", "SELECT wallet, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS total_transactions FROM ends GROUP BY 1")
def _(v):
    return Q.identity_activity(v.transfers)


SQL_VIEWS["ends2"] = """SELECT sender AS wallet, receiver AS counterparty, true AS is_sender, amount_lamports FROM transfers UNION ALL SELECT receiver, sender, false, amount_lamports FROM transfers"""


@query("q03_graph_summary", """SELECT e.wallet, inbound, outbound, inbound_lamports, outbound_lamports, unique_counterparties, high_risk_neighbors, c.cluster_id, coalesce(cluster_size, 0) AS cluster_size,
    coalesce(d, 0.0)::DOUBLE AS cluster_risk_density FROM (SELECT wallet, count(*) FILTER (NOT is_sender) AS inbound, count(*) FILTER (is_sender) AS outbound, CAST(coalesce(sum(amount_lamports) FILTER (NOT is_sender), 0) AS BIGINT) AS inbound_lamports,
      CAST(coalesce(sum(amount_lamports) FILTER (is_sender), 0) AS BIGINT) AS outbound_lamports, count(DISTINCT counterparty) AS unique_counterparties,
      count(DISTINCT CASE WHEN counterparty IN (SELECT wallet FROM p_scores WHERE score < 50) THEN counterparty END) AS high_risk_neighbors FROM ends2 GROUP BY 1) e
    LEFT JOIN c_size c ON c.wallet = e.wallet LEFT JOIN (SELECT cluster_id, round(count(*) FILTER (score < 50) / count(*)::DOUBLE * 10000) / 10000 AS d FROM cluster_members LEFT JOIN p_scores USING (wallet) GROUP BY 1) x
      ON x.cluster_id = c.cluster_id""")
def _(v):
    return Q.graph_summary(v.transfers, partial_scores(v), v.cluster_members)


_PAIRS = """SELECT e.wallet, counterparty, count(*) FILTER (NOT is_sender) AS inbound_tx, count(*) FILTER (is_sender) AS outbound_tx, count(*) AS total_tx,
    CAST(sum(amount_lamports) AS BIGINT) AS total_volume_lamports, coalesce(any_value(s.score), 0.0) AS trust_score FROM ends2 e LEFT JOIN {s} s ON s.wallet = counterparty GROUP BY 1, 2"""
SQL_VIEWS["cp"] = _PAIRS.format(s="p_scores")
SQL_VIEWS["cp_sum"] = """SELECT wallet, count(*) AS total_counterparties, count(*) FILTER (trust_score < 50) AS high_risk_counterparties,
    round(count(*) FILTER (trust_score < 50) / count(*)::DOUBLE * 10000) / 10000 AS exposure_ratio FROM cp GROUP BY 1"""
SQL_VIEWS["cp_prev"] = """SELECT *, CASE WHEN normalized_impact >= 70 THEN 'HIGH' WHEN normalized_impact >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_signal FROM (
    SELECT wallet, count(*) AS total_neighbors, CAST(sum(total_tx) AS BIGINT) AS total_transactions, sum(CAST((100 - trust_score) * total_tx AS DECIMAL(28, 6)))::DOUBLE AS raw_impact,
    round(sum(CAST((100 - trust_score) * total_tx AS DECIMAL(28, 6)))::DOUBLE / sum(total_tx) * 100) / 100 AS normalized_impact FROM cp GROUP BY 1)"""


def cps(v):
    return Q.counterparties(v.transfers, partial_scores(v))


@query("q04_counterparties", "SELECT *, CASE WHEN trust_score >= 80 THEN 'LOW' WHEN trust_score >= 50 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM cp")
def _(v):
    return cps(v)[0]


@query("q04_counterparty_summary", "SELECT * FROM cp_sum")
def _(v):
    return cps(v)[1]


@query("q04_counterparties_large", """SELECT wallet, counterparty, inbound_tx, outbound_tx, total_volume_lamports FROM (
    SELECT sender AS wallet, receiver AS counterparty, 0 AS inbound_tx, count(*) AS outbound_tx, CAST(sum(amount_lamports) AS BIGINT) AS total_volume_lamports FROM transfers_large GROUP BY 1, 2
    UNION ALL SELECT receiver, sender, count(*), 0, CAST(sum(amount_lamports) AS BIGINT) FROM transfers_large GROUP BY 1, 2)""")
def _(v):
    return Q.counterparties(v.transfers_large, v.latest_scores)[0].select(
        "wallet", "counterparty", "inbound_tx", "outbound_tx", "total_volume_lamports")


@query("q05_propagation_preview", "SELECT * FROM cp_prev")
def _(v):
    return Q.propagation_preview(cps(v)[0])


_CAT = """CASE WHEN s <= 30 AND x >= 0.5 THEN 'TOXIC_NODE' WHEN s <= 30 AND x = 0 THEN 'SELF_RISK' WHEN s > 30 AND x >= 0.5 THEN 'NETWORK_EXPOSED' WHEN x > 0 AND s >= 50 THEN 'MONITORED'
    WHEN s >= 60 AND x = 0 THEN 'CLEAN' ELSE 'NEUTRAL' END"""
_CONF = "CASE WHEN category IN ('TOXIC_NODE', 'SELF_RISK') THEN 'HIGH' WHEN category IN ('NETWORK_EXPOSED', 'MONITORED') THEN 'MEDIUM' ELSE 'LOW' END"
# full scores and six-hour wallets give a wider spread of categories
SQL_VIEWS["six_scores"] = """SELECT DISTINCT w AS wallet, s.score FROM (SELECT sender AS w FROM transfers_six_hour UNION ALL SELECT receiver FROM transfers_six_hour)
    JOIN latest_scores s ON s.wallet = split_part(w, '@', 1)"""
SQL_VIEWS["six_x"] = """SELECT wallet, round(count(*) FILTER (sc < 50) / count(*)::DOUBLE * 10000) / 10000 AS x FROM (SELECT e.wallet, e.counterparty, coalesce(any_value(score), 0) AS sc FROM (
    SELECT sender AS wallet, receiver AS counterparty FROM transfers_six_hour UNION ALL SELECT receiver, sender FROM transfers_six_hour) e LEFT JOIN six_scores s ON s.wallet = e.counterparty GROUP BY 1, 2) GROUP BY 1"""


@query("q06_wallet_category", f"SELECT wallet, category, {_CONF} AS confidence FROM (SELECT wallet, {_CAT} AS category FROM (SELECT wallet, coalesce(score, 50.0) AS s, x FROM six_x LEFT JOIN six_scores USING (wallet)))")
def _(v):
    t = v.transfers_six_hour
    s = t.select(F.explode(F.array("sender", "receiver")).alias("wallet")).distinct().join(
        v.latest_scores.select(F.col("wallet").alias("w"), "score"), F.split("wallet", "@")[0] == F.col("w")).drop("w")
    return Q.wallet_category(s, Q.counterparties(t, s)[1])


_FLAGS = """array_to_string(list_filter([CASE WHEN total_transactions = 0 THEN 'ISOLATED' END, CASE WHEN cluster_id IS NOT NULL AND cluster_size > 1 THEN 'CLUSTERED' END,
    CASE WHEN exposure_ratio > 0 THEN 'EXPOSED' END, CASE WHEN exposure_ratio >= 0.5 OR normalized_impact >= 70 THEN 'CONTAMINATED' END, CASE WHEN trust_score < 50 THEN 'HIGH_RISK_SELF' END], lambda x: x IS NOT NULL), ',')"""


@query("q07_wallet_flags", f"SELECT wallet, {_FLAGS} AS flags FROM profile JOIN cp_sum USING (wallet) JOIN (SELECT wallet, normalized_impact FROM cp_prev) USING (wallet)")
def _(v):
    pairs, summary = cps(v)
    prof = Q.identity_profile(partial_scores(v), v.cluster_members, v.transfers, v.wallet_reasons)
    return Q.wallet_flags(prof, summary, Q.propagation_preview(pairs)).withColumn("flags", F.array_join("flags", ","))


def _texts(items) -> str:
    return "'" + "|".join(items) + "'"


_ACTIONS = ("CASE " + " ".join(f"WHEN category = '{k}' THEN {_texts(t)}" for k, t in P.ACTIONS_BY_CATEGORY.items())
            + f" WHEN il = 'HIGH' THEN {_texts(P.ACTIONS_INTRINSIC_HIGH)} WHEN cl = 'HIGH' THEN {_texts(P.ACTIONS_CONTEXTUAL_HIGH)} ELSE {_texts(P.ACTIONS_DEFAULT)} END")


@query("q08_summary_compact", f"""SELECT wallet, s AS trust_score, il AS intrinsic_risk_level, cl AS contextual_risk_level, CASE WHEN il = 'HIGH' THEN 'RISKY' WHEN cl = 'HIGH' THEN 'REVIEW' ELSE 'SAFE' END AS simple_status,
    CASE WHEN il = 'HIGH' THEN 'HIGH' WHEN cl = 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier, CASE WHEN il = 'HIGH' THEN 'RED' WHEN cl = 'HIGH' THEN 'AMBER' ELSE 'GREEN' END AS risk_color,
    driver, category, {_CONF} AS confidence, cluster_id, cluster_size, x AS exposure_ratio, risk_signal AS propagation_signal, badges, {_ACTIONS} AS recommended_actions, last_updated FROM (
    SELECT *, {_CAT} AS category, CASE WHEN s <= 30 THEN 'HIGH' WHEN s < 60 THEN 'MEDIUM' ELSE 'LOW' END AS il, CASE WHEN x >= 0.5 THEN 'HIGH' WHEN x > 0 THEN 'MEDIUM' ELSE 'LOW' END AS cl FROM (
      SELECT p.wallet, trust_score AS s, exposure_ratio AS x, cluster_id, cluster_size, risk_signal, {_FLAGS} AS badges, driver, s.computed_at AS last_updated FROM profile p JOIN cp_sum USING (wallet)
      JOIN (SELECT wallet, normalized_impact, risk_signal FROM cp_prev) USING (wallet) LEFT JOIN (SELECT wallet, arg_min(reason_code || ':' || weight, (weight, reason_code)) AS driver FROM wallet_reasons WHERE weight < 0 GROUP BY 1) USING (wallet)
      LEFT JOIN p_scores s ON s.wallet = p.wallet))""")
def _(v):
    d = F.col("primary_risk_driver")
    return Q.summary_compact(partial_scores(v), v.cluster_members, v.transfers, v.wallet_reasons).withColumns({
        "driver": F.concat(d["code"], F.lit(":"), d["weight"].cast("string")), "badges": F.array_join("badges", ","),
        "recommended_actions": F.array_join("recommended_actions", "|")}).drop("primary_risk_driver", "summary_message")


@query("q09_recommended_actions", f"SELECT wallet, {_ACTIONS} AS actions FROM (SELECT wallet, {_CAT} AS category, CASE WHEN s <= 30 THEN 'HIGH' ELSE 'LOW' END AS il, CASE WHEN x >= 0.5 THEN 'HIGH' ELSE 'LOW' END AS cl FROM (SELECT wallet, score AS s, (100 - score) / 150 AS x FROM latest_scores))")
def _(v):
    s, x = F.col("score"), (100 - F.col("score")) / 150
    return v.latest_scores.select("wallet", F.array_join(S.recommended_actions(
        Q._category(s, x), F.when(s <= 30, "HIGH").otherwise("LOW"), F.when(x >= 0.5, "HIGH").otherwise("LOW")), "|").alias("actions"))


@query("q10_top_neighbors", """SELECT e.wallet, counterparty AS neighbor, count(*) AS interactions, coalesce(any_value(score), 50.0) AS risk_score FROM ends e LEFT JOIN p_scores s ON s.wallet = counterparty
    WHERE counterparty <> e.wallet GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY e.wallet ORDER BY count(*) DESC, counterparty) <= 20""")
def _(v):
    return Q.top_neighbors(v.transfers, partial_scores(v))


SQL_VIEWS["flow_rows"] = """SELECT wallet, target, min(kind) AS kind FROM (SELECT x.wallet, y.wallet AS target, 1 AS kind FROM cluster_members x JOIN cluster_members y ON x.cluster_id = y.cluster_id AND x.wallet <> y.wallet
    UNION ALL SELECT wallet, counterparty, 2 FROM ends WHERE wallet <> counterparty) GROUP BY 1, 2"""


SQL_VIEWS["c_several"] = "SELECT DISTINCT cluster_id, wallet FROM cluster_members WHERE cluster_id IN (SELECT cluster_id FROM cluster_members GROUP BY 1 HAVING count(DISTINCT wallet) > 1)"
SQL_VIEWS["apart"] = """SELECT DISTINCT wallet, counterparty AS node FROM ends e WHERE wallet <> counterparty AND NOT EXISTS (SELECT 1 FROM cluster_members x JOIN cluster_members y ON y.cluster_id = x.cluster_id
    WHERE x.wallet = e.wallet AND y.wallet = e.counterparty)"""


@query("q11_flow_paths", """SELECT source, cluster_id, target, relationship, CASE WHEN target IS NOT NULL AND coalesce(score, 50) < 25 THEN 'HIGH' END AS risk FROM (
    SELECT wallet AS source, NULL AS cluster_id, node AS target, 'interaction' AS relationship FROM apart UNION ALL SELECT wallet, cluster_id, NULL, 'cluster' FROM c_several
    UNION ALL SELECT NULL, cluster_id, wallet, 'member' FROM c_several) f LEFT JOIN p_scores s ON s.wallet = target""")
def _(v):
    return Q.flow_paths(v.transfers, v.cluster_members, partial_scores(v))


@query("q11_flow_paths_unfolded", """SELECT f.wallet AS source, target, CASE kind WHEN 1 THEN 'cluster' ELSE 'interaction' END AS relationship, CASE WHEN coalesce(score, 50) < 25 THEN 'HIGH' END AS risk FROM flow_rows f
    LEFT JOIN p_scores s ON s.wallet = target WHERE f.wallet IN (FROM scam_wallets)""")
def _(v):
    return Q.paths_of(Q.flow_paths(v.transfers, v.cluster_members, partial_scores(v)), v.scam_wallets)


@query("q11_flow_paths_first", """SELECT f.wallet AS source, target, CASE kind WHEN 1 THEN 'cluster' ELSE 'interaction' END AS relationship, CASE WHEN coalesce(score, 50) < 25 THEN 'HIGH' END AS risk FROM (
    SELECT * FROM flow_rows QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY kind, target) <= 50) f LEFT JOIN p_scores s ON s.wallet = target""")
def _(v):
    return Q.flow_paths(v.transfers, v.cluster_members, partial_scores(v), 50)


SQL_VIEWS["ig_rows"] = """SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY kind, node) AS rn FROM (SELECT wallet, node, min(kind) AS kind FROM (
    SELECT DISTINCT wallet, wallet AS node, 0 AS kind FROM flow_rows UNION ALL SELECT wallet, counterparty, 1 FROM ends WHERE wallet <> counterparty
    UNION ALL SELECT x.wallet, y.wallet, 2 FROM cluster_members x JOIN cluster_members y ON x.cluster_id = y.cluster_id AND x.wallet <> y.wallet) GROUP BY 1, 2)"""


@query("q12_identity_graph_nodes_first", "SELECT r.wallet, node, coalesce(score, 50.0) AS risk FROM ig_rows r LEFT JOIN p_scores s ON s.wallet = node WHERE rn <= 30")
def _(v):
    return Q.identity_graph(v.transfers, v.cluster_members, partial_scores(v), 30, 20)[0]


@query("q12_identity_graph_edges_first", "SELECT wallet, least(wallet, node) AS source, greatest(wallet, node) AS target FROM ig_rows WHERE rn <= 21 AND kind > 0")
def _(v):
    return Q.identity_graph(v.transfers, v.cluster_members, partial_scores(v), 30, 20)[1]


@query("q12_identity_graph_nodes", """SELECT f.wallet, cluster_id, node, CASE WHEN node IS NOT NULL THEN coalesce(score, 50.0) END AS risk FROM (
    SELECT DISTINCT wallet, NULL AS cluster_id, wallet AS node FROM (SELECT wallet FROM apart UNION ALL SELECT wallet FROM c_several) UNION ALL SELECT wallet, NULL, node FROM apart
    UNION ALL SELECT wallet, cluster_id, NULL FROM c_several UNION ALL SELECT NULL, cluster_id, wallet FROM c_several) f LEFT JOIN p_scores s ON s.wallet = node""")
def _(v):
    return Q.identity_graph(v.transfers, v.cluster_members, partial_scores(v))[0]


@query("q12_identity_graph_edges", """SELECT wallet, NULL AS cluster_id, least(wallet, node) AS source, greatest(wallet, node) AS target FROM apart
    UNION ALL SELECT wallet, cluster_id, NULL, NULL FROM c_several""")
def _(v):
    return Q.identity_graph(v.transfers, v.cluster_members, partial_scores(v))[1]


def cluster_types(v):
    """A cluster counts as scam when a member is a known scam wallet."""
    bad = v.cluster_members.join(v.scam_wallets, "wallet", "left_semi").select("cluster_id", F.lit("scam").alias("cluster_type")).distinct()
    return v.cluster_members.select("cluster_id").distinct().join(bad, "cluster_id", "left").withColumn("confidence", F.lit(0.8))


SQL_VIEWS["c_scam"] = "SELECT DISTINCT cluster_id FROM cluster_members WHERE wallet IN (FROM scam_wallets)"
SQL_VIEWS["pl_tab"] = constant_view("code, label", P.PATTERN_LABELS)
SQL_VIEWS["patt"] = """SELECT wallet, list(label ORDER BY rn) AS pattern FROM (SELECT wallet, label, min(rn) AS rn FROM (SELECT wallet, coalesce(label,
      array_to_string(list_transform(string_split(reason_code, '_'), lambda s: upper(s[1]) || lower(s[2:])), ' ')) AS label, row_number() OVER (PARTITION BY wallet ORDER BY created_at DESC, tx_hash DESC) AS rn
      FROM wallet_reasons LEFT JOIN pl_tab ON code = reason_code) WHERE rn <= 5 GROUP BY 1, 2) GROUP BY 1"""


def _b(a, b, c, d):
    return f"CASE WHEN s < 30 THEN '{a}' WHEN s < 50 THEN '{b}' WHEN s < 70 THEN '{c}' ELSE '{d}' END"


@query("q13_wallet_overview", f"""SELECT wallet, CAST(round(s) AS INTEGER) AS trust_score, {_b('HIGH', 'MEDIUM', 'LOW', 'SAFE')} AS risk_level, {_b('RED', 'ORANGE', 'YELLOW', 'GREEN')} AS risk_color,
    array_to_string(pattern, ',') AS behavioral_pattern, cluster_id, cluster_size, CASE WHEN s < 40 THEN 'HIGH' WHEN s < 60 THEN 'MEDIUM' ELSE 'LOW' END AS propagation_signal,
    CASE WHEN scam THEN 'SCAM_CLUSTER' END AS primary_risk_driver, CASE WHEN scam THEN 'SCAM_CLUSTER' ELSE {_b('HIGH_RISK', 'MEDIUM_RISK', 'LOW_RISK', 'SAFE')} END AS category, 'HIGH' AS confidence,
    CASE WHEN scam THEN 'Wallet is linked to a scam cluster with ' || (cluster_size - 1) || ' other members.' ELSE 'No major threats detected.' END AS summary_message,
    coalesce(nullif(array_to_string(list_filter([CASE WHEN scam THEN 'Disconnect from all token approvals linked to this cluster.' END, CASE WHEN scam THEN 'Avoid interacting with wallets in Cluster #' || cluster_id || '.' END,
      CASE WHEN lower(array_to_string(pattern, ',')) LIKE '%cluster%' THEN 'Review recent counterparties for suspicious activity.' END,
      CASE WHEN lower(array_to_string(pattern, ',')) LIKE '%cluster%' THEN 'Reassess cluster-related transaction patterns.' END,
      CASE WHEN list_contains(pattern, 'New wallet') THEN 'Monitor this new wallet closely before trusting it.' END, CASE WHEN list_contains(pattern, 'Long-term holder') THEN 'Verify wallet identity before large transfers.' END,
      CASE WHEN list_contains(pattern, 'Clean history') THEN 'No immediate action required. Continue monitoring.' END, CASE WHEN s < 30 THEN 'Do NOT send funds to this wallet.' END,
      CASE WHEN s < 30 THEN 'Report wallet to Solana community watchlists.' END, CASE WHEN s >= 30 AND s < 50 THEN 'Exercise caution before any interaction.' END], lambda x: x IS NOT NULL), '|'), ''),
      'Monitor wallet for unusual activity.|Verify all recent transactions.') AS recommended_actions, round((100 - s) / 100 * 100) / 100 AS exposure_ratio
    FROM (SELECT l.wallet, l.score AS s, pattern, c.cluster_id, cluster_size, c.cluster_id IN (FROM c_scam) AS scam FROM latest_scores l JOIN c_size c USING (wallet) JOIN patt USING (wallet))""")
def _(v):
    s = v.latest_scores.withColumn("risk_level", F.lit(""))
    return Q.wallet_overview(s, v.wallet_reasons, v.cluster_members, cluster_types(v)).withColumns({
        "behavioral_pattern": F.array_join("behavioral_pattern", ","), "recommended_actions": F.array_join("recommended_actions", "|")})


@query("q14_wallet_dashboard", f"""SELECT l.wallet, CAST(round(score) AS INTEGER) AS trust_score, CASE WHEN is_anomalous THEN 'HIGH' ELSE 'unknown' END AS risk_tier, age AS wallet_age_days, n AS total_transactions, u AS unique_counterparties, v AS volume_30d,
    age > 90 AS long_term_holder, round(score) >= 70 AS low_risk_network, contains(rs, 'DRAINER') AS drainer_pattern, rs AS reasons, bs AS badges FROM latest_scores l JOIN (SELECT wallet, ({AS_OF + 66 * DAY} - min(ts)) // {DAY} AS age, count(*) AS n,
      count(DISTINCT CASE WHEN counterparty <> wallet THEN counterparty END) AS u, round(coalesce(sum(amount_lamports) FILTER (ts >= {AS_OF + 36 * DAY}), 0) / {D} * 100) / 100 AS v FROM ends GROUP BY 1) USING (wallet)
    JOIN (SELECT wallet, string_agg(reason_code, ',' ORDER BY rn) AS rs FROM (SELECT wallet, reason_code, min(rn) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY created_at DESC, tx_hash DESC) AS rn FROM wallet_reasons) GROUP BY 1, 2) GROUP BY 1) USING (wallet)
    JOIN (SELECT wallet, string_agg(badge, ',' ORDER BY rn) AS bs FROM (SELECT wallet, badge, min(rn) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, badge) AS rn FROM (
      SELECT wallet, {BADGE5} AS badge, max(computed_at) AS ts FROM score_timeline GROUP BY 1, 2)) GROUP BY 1, 2) GROUP BY 1) USING (wallet)""")
def _(v):
    s = v.latest_scores.withColumn("risk_level", F.when(F.col("is_anomalous"), "HIGH"))
    b = v.score_timeline.groupBy("wallet", S.badge(F.col("score"))["name"].alias("badge")).agg(F.max("computed_at").alias("ts"))
    return Q.wallet_dashboard(s, v.transfers, v.wallet_reasons, b, AS_OF + 66 * DAY).withColumns(
        {"reasons": F.array_join("reasons", ","), "badges": F.array_join("badges", ",")})


SQL_VIEWS["bp_tab"] = constant_view("code, phrase", P.BADGE_PHRASES)


@query("q15_investigation_badge", f"""SELECT l.wallet, round(score * 100) / 100 AS score, {BADGE5} AS badge, 'Wallet marked ' || {BADGE5} || coalesce(' due to ' || ph || '.', '. No negative indicators.') AS badge_reason_summary,
    tc AS top_reason_codes, c.cluster_id, cluster_size, scam_ratio, n AS recent_suspicious_tx_count, ch AS score_change_30d FROM latest_scores l
    LEFT JOIN (SELECT wallet, string_agg(reason_code, ',' ORDER BY rn) AS tc FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY created_at DESC, reason_code) AS rn FROM r_unique) WHERE rn <= 5 GROUP BY 1) USING (wallet)
    LEFT JOIN (SELECT wallet, string_agg(phrase, ' and ' ORDER BY rn) AS ph FROM (SELECT wallet, coalesce(phrase, lower(replace(reason_code, '_', ' '))) AS phrase, row_number() OVER (PARTITION BY wallet ORDER BY created_at DESC, reason_code) AS rn
      FROM r_unique LEFT JOIN bp_tab ON code = reason_code WHERE weight < 0) WHERE rn <= 5 GROUP BY 1) USING (wallet)
    LEFT JOIN c_size c USING (wallet) LEFT JOIN c_ratio r ON r.cluster_id = c.cluster_id LEFT JOIN sus_tx ON sus_tx.wallet = l.wallet
    LEFT JOIN (SELECT s.wallet, round((s.score - o.old) * 10) / 10 AS ch FROM latest_scores s JOIN (SELECT wallet, arg_max(score, (computed_at, id)) AS old FROM score_timeline WHERE computed_at <= {AS_OF - 29 * DAY} GROUP BY 1) o USING (wallet)) x ON x.wallet = l.wallet""")
def _(v):
    r = v.wallet_reasons.groupBy("wallet", "reason_code").agg(F.max("created_at").alias("created_at")).join(
        unique(v).select("wallet", "reason_code", "weight"), ["wallet", "reason_code"])
    h = v.score_timeline.withColumnRenamed("computed_at", "snapshot_at").withColumn("posterior", F.lit(None).cast("double"))
    return Q.investigation_badge(v.latest_scores, r, v.cluster_members, v.transfers, v.scam_wallets, h, AS_OF + DAY).withColumn(
        "top_reason_codes", F.array_join("top_reason_codes", ","))


SQL_VIEWS["some_cl"] = "SELECT DISTINCT wallet FROM cluster_members WHERE cluster_id IN (FROM c_scam)"


@query("q16_check_transfers", """SELECT signature, receiver, amount, token, CASE WHEN clu AND lv < 3 THEN greatest(lv, 2) ELSE lv END AS risk_level, coalesce(txt, CASE WHEN clu AND lv < 3 THEN 'Receiver linked to scam cluster' END) AS warning_reason,
    conf AS confidence, sc AS to_score, bd AS to_badge, top_reason, clu AS cluster_link, CASE WHEN amount >= 10 AND lv > 0 THEN 'large_transfer_to_risky' WHEN bad THEN 'drainer_or_scam' END AS special_warning FROM (
    SELECT signature, receiver, amount_lamports / CAST(1e9 AS DOUBLE) AS amount, token, s.score AS sc, top_reason, b.wallet IS NOT NULL AS bad, c.wallet IS NOT NULL AS clu,
      CASE WHEN b.wallet IS NOT NULL OR s.score < 20 THEN 3 WHEN s.score < 40 THEN 2 WHEN s.score < 70 THEN 1 ELSE 0 END AS lv,
      CASE WHEN b.wallet IS NOT NULL THEN 'Receiver is a known scam wallet' WHEN s.score < 20 THEN coalesce(top_reason, 'Receiver has very low trust score') WHEN s.score < 40 THEN coalesce(top_reason, 'Receiver has low trust score')
        WHEN s.score < 70 THEN 'Receiver has moderate risk' END AS txt, CASE WHEN b.wallet IS NOT NULL THEN 1.0 WHEN s.score < 20 THEN 0.9 WHEN s.score < 40 THEN 0.85 WHEN s.score < 70 THEN 0.7 ELSE 0.0 END::DOUBLE AS conf,
      CASE WHEN s.score IS NULL THEN 'UNKNOWN' WHEN s.score >= 70 THEN 'TRUSTED' WHEN s.score >= 50 THEN 'LOW_RISK' WHEN s.score >= 30 THEN 'MEDIUM_RISK' WHEN s.score >= 10 THEN 'HIGH_RISK' ELSE 'SCAM_SUSPECTED' END AS bd
    FROM transfers t LEFT JOIN p_scores s ON s.wallet = t.receiver LEFT JOIN scam_wallets b ON b.wallet = t.receiver LEFT JOIN some_cl c ON c.wallet = t.receiver
    LEFT JOIN (SELECT wallet, arg_max(reason_code, (abs(weight), reason_code)) AS top_reason FROM wallet_reasons GROUP BY 1) r ON r.wallet = t.receiver)""")
def _(v):
    return Q.check_transfers(proposed(v), receivers(v))


def proposed(v):
    return v.transfers.select("signature", "receiver", (F.col("amount_lamports") / 1e9).alias("amount"), "token")


def receivers(v):
    some = v.cluster_members.join(cluster_types(v).filter("cluster_type = 'scam'"), "cluster_id", "left_semi")
    return Q.receiver_risk(partial_scores(v), v.wallet_reasons, some, v.scam_wallets)


@query("q17_batch_scores", """SELECT w.wallet, round(score * 100) / 100 AS score, CASE WHEN score <= 25 THEN 3 WHEN score <= 50 THEN 2 WHEN score <= 75 THEN 1 WHEN score IS NOT NULL THEN 0 END AS risk,
    strftime(make_timestamp(computed_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS updated_at, CASE WHEN score IS NULL THEN 'not_scored' ELSE 'ok' END AS status FROM wallets w LEFT JOIN p_scores USING (wallet)""")
def _(v):
    return Q.batch_scores(v.wallets, partial_scores(v))


_NEST = "string_agg({x}, ';' ORDER BY rn)"


@query("q18_wallet_report", f"""SELECT l.wallet, score, cluster_id, cluster_size, rs AS reasons, ts AS transfers, ss AS snapshots FROM latest_scores l LEFT JOIN c_size USING (wallet)
    LEFT JOIN (SELECT wallet, {_NEST.format(x="reason_code || ':' || weight")} AS rs FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY abs(weight) DESC, reason_code) AS rn FROM r_unique) WHERE rn <= 5 GROUP BY 1) USING (wallet)
    LEFT JOIN (SELECT wallet, {_NEST.format(x="signature || ':' || counterparty")} AS ts FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, signature DESC) AS rn FROM ends) WHERE rn <= 10 GROUP BY 1) USING (wallet)
    LEFT JOIN (SELECT wallet, {_NEST.format(x="computed_at::VARCHAR")} AS ss FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY computed_at DESC, id DESC) AS rn FROM score_timeline) WHERE rn <= 10 GROUP BY 1) USING (wallet)""")
def _(v):
    r = Q.wallet_report(v.latest_scores, unique(v), v.cluster_members, v.transfers, v.score_timeline)
    text = lambda c, *f: F.array_join(F.transform(c, lambda e: F.concat_ws(":", *[e[x].cast("string") for x in f])), ";")
    return r.select("wallet", "score", "cluster_id", "cluster_size", text("reasons", "reason_code", "weight").alias("reasons"),
                    text("transfers", "signature", "counterparty").alias("transfers"), text("snapshots", "computed_at").alias("snapshots"))


def oracle_inputs(v):
    rules = test_flags(v).select("wallet", F.transform("flags", lambda f: f["rule_name"]).alias("rules"))
    s = v.latest_scores.join(rules, "wallet", "left")
    c = R.cluster_risk(v.cluster_members, v.latest_scores).select(
        "cluster_id", F.lit(0.5).alias("confidence"), F.array(F.lit("shared_funding")).alias("reason_tags"),
        F.col("risk").alias("cluster_risk"), F.lit(AS_OF - 10).cast("bigint").alias("risk_updated_at"))
    e = ent_rep(v).withColumn("last_updated", F.lit(AS_OF).cast("bigint"))
    return s, T.reputation_state(v.score_timeline, AS_OF), c, e


def _oracle(v, level):
    s, r, c, e = oracle_inputs(v)
    h = _entity_history(v)[1] if level == "entity" else None
    return Q.oracle_view(level, s, r, c, e, v.cluster_members, h).withColumn("reason_tags", F.array_join("reason_tags", ";"))


_LV = "CASE WHEN {x} < 30 THEN 'critical' WHEN {x} < 50 THEN 'high' WHEN {x} < 70 THEN 'medium' ELSE 'low' END"


@query("q19_oracle_wallet", f"""SELECT l.wallet AS id, round(l.score * 100) / 100 AS trust_score, {_LV.format(x='(round(l.score * 100) / 100)')} AS risk_level, round(e.score * 100) / 100 AS entity_reputation, round(k.risk * 100) / 100 AS cluster_risk,
    'shared_funding' || CASE WHEN e.tags LIKE 'cluster%' THEN ';cluster_contamination' ELSE '' END || CASE WHEN e.tags LIKE '%repeated%' THEN ';repeated_anomalies' ELSE '' END AS reason_tags, l.computed_at AS last_updated,
    nr || ' anomaly flag(s): ' || rules AS anomaly_summary, 'Trend: ' || t.trend || '; avg_7d=' || coalesce(avg_7d::VARCHAR, 'None') || '; avg_30d=' || coalesce(avg_30d::VARCHAR, 'None') AS historical_trend
    FROM latest_scores l JOIN cluster_members m USING (wallet) JOIN ent_rep e ON e.entity_id = m.cluster_id JOIN c_risk k ON k.cluster_id = m.cluster_id JOIN rep_state t ON t.wallet = l.wallet
    LEFT JOIN (SELECT wallet, count(*) AS nr, string_agg(CASE type WHEN 'burst_transactions' THEN 'burst_tx_frequency_per_day' WHEN 'suspicious_velocity' THEN 'suspicious_velocity_sol_per_day' ELSE type END, ', ' ORDER BY pos) AS rules FROM flag_rows GROUP BY 1) f ON f.wallet = l.wallet""")
def _(v):
    return _oracle(v, "wallet")


@query("q19_oracle_entity", f"""SELECT e.entity_id::VARCHAR AS id, e.score AS trust_score, {_LV.format(x='(100 - k.risk)')} AS risk_level, e.score AS entity_reputation, round(k.risk * 100) / 100 AS cluster_risk,
    CASE WHEN e.tags LIKE ';%' THEN substr(e.tags, 2) ELSE e.tags END AS reason_tags, {AS_OF} AS last_updated, NULL::VARCHAR AS anomaly_summary, CASE WHEN h.n >= 2 THEN 'Entity trend: ' || CASE WHEN recent > older THEN 'improving' WHEN recent < older THEN 'degrading' ELSE 'stable' END
      || ' (recent=' || round(recent::DECIMAL(12, 4), 1)::DECIMAL(12, 1) || ', older=' || round(older::DECIMAL(12, 4), 1)::DECIMAL(12, 1) || ')' END AS historical_trend
    FROM ent_rep e JOIN c_risk k ON k.cluster_id = e.entity_id LEFT JOIN (SELECT entity_id, arg_min(score, rank) AS recent, arg_max(score, rank) AS older, count(*) AS n FROM ent_ranked WHERE rank <= 10 GROUP BY 1) h ON h.entity_id = e.entity_id""")
def _(v):
    return _oracle(v, "entity")


@query("q19_oracle_cluster", f"""SELECT k.cluster_id::VARCHAR AS id, round((100 - k.risk) * 100) / 100 AS trust_score, {_LV.format(x='(100 - k.risk)')} AS risk_level, round(e.score * 100) / 100 AS entity_reputation, round(k.risk * 100) / 100 AS cluster_risk,
    'shared_funding' AS reason_tags, {AS_OF} AS last_updated, NULL::VARCHAR AS anomaly_summary, 'confidence=0.5; members=' || members AS historical_trend FROM c_risk k JOIN ent_rep e ON e.entity_id = k.cluster_id""")
def _(v):
    return _oracle(v, "cluster")


SQL_VIEWS["fp"] = """SELECT l.wallet, l.score, coalesce(t.tx_count, 0) AS tx_to_scam, round(coalesce(sol, 0) * 10000) / 10000 AS sol_to_scam, r4 AS scam_ratio,
    (coalesce(t.tx_count, 0) <= 1 AND coalesce(sol, 0) < 0.1) OR l.wallet IN (SELECT wallet FROM latest_scores WHERE NOT is_anomalous) AS hit FROM (SELECT wallet, score - 40 AS score FROM latest_scores WHERE score - 40 < 20) l
    LEFT JOIN to_scam t USING (wallet) LEFT JOIN c_size c USING (wallet) LEFT JOIN (SELECT cluster_id, round(count(s.wallet) / count(*)::DOUBLE * 10000) / 10000 AS r4 FROM cluster_members m LEFT JOIN scam_wallets s ON s.wallet = m.wallet GROUP BY 1) x ON x.cluster_id = c.cluster_id"""


def _fp(v):
    s = v.latest_scores.withColumn("score", F.col("score") - 40)
    return Q.false_positive_candidates(s, v.transfers, v.scam_wallets, v.cluster_members, v.latest_scores.filter("NOT is_anomalous"))


@query("q20_false_positive_candidates", "SELECT wallet, score, tx_to_scam, sol_to_scam, scam_ratio FROM fp WHERE hit")
def _(v):
    return _fp(v)[0]


@query("q20_false_positive_rate", "SELECT count(*) AS low_scores, count(*) FILTER (hit) AS candidates, round(coalesce(count(*) FILTER (hit) / nullif(count(*), 0)::DOUBLE, 0) * 10000) / 10000 AS rate FROM fp")
def _(v):
    return _fp(v)[1]


@query("q21_wallet_pipeline_stats", """WITH x AS (SELECT l.wallet, score, (100 - score) / 250 >= 0.3 OR coalesce(rs, 0) >= 1400 AS sus, is_anomalous AS pub, d.wallet IS NOT NULL AS dr FROM latest_scores l
      LEFT JOIN (SELECT wallet, sum(n * CASE code WHEN 'DRAINER_INTERACTION' THEN 20 WHEN 'HIGH_VALUE_OUTFLOW' THEN 10 WHEN 'NEW_WALLET' THEN 5 WHEN 'LOW_ACTIVITY' THEN 3 ELSE 0 END) AS rs FROM ev_counts GROUP BY 1) USING (wallet)
      LEFT JOIN (SELECT DISTINCT wallet FROM wallet_reasons WHERE reason_code LIKE '%DRAINER%') d USING (wallet))
    SELECT metric, "value", "text" FROM (VALUES ('tracked', (SELECT count(*) FROM wallets)::DOUBLE, NULL), ('analyzed', (SELECT count(*) FROM x)::DOUBLE, NULL), ('suspicious', (SELECT count(*) FROM x WHERE sus)::DOUBLE, NULL), ('drainers', (SELECT count(*) FROM x WHERE dr)::DOUBLE, NULL),
      ('average_score', (SELECT round(sum(CAST(score AS DECIMAL(28, 6)))::DOUBLE / count(*) * 100) / 100 FROM x), NULL), ('publish_rate', (SELECT round(count(*) FILTER (pub) / count(*)::DOUBLE * 10000) / 10000 FROM x), NULL),
      ('worst_wallet', (SELECT min(score) FROM x), (SELECT wallet FROM x ORDER BY score, wallet LIMIT 1))) AS t(metric, "value", "text")""")
def _(v):
    from ledgerwise.operators.reasons import evidence_summary

    s = v.latest_scores.select("wallet", "score", ((100 - F.col("score")) / 250).alias("scam_probability"), F.col("is_anomalous").alias("published"))
    pen = evidence_summary(v.reason_evidence).select("wallet", F.when(F.col("reason_risk_score") >= 1400, 30).otherwise(0).alias("reason_risk_score"))
    return Q.wallet_pipeline_stats(s, v.wallet_reasons, pen, v.tracked_wallets)


@query("q22_publish_candidates", """SELECT wallet, score - 5 AS score, CASE WHEN is_anomalous THEN 2 WHEN score < 80 THEN 4 ELSE 1 END AS risk FROM latest_scores WHERE score - 5 BETWEEN 0 AND 100 AND wallet NOT IN (SELECT wallet FROM reviews) AND wallet NOT IN (FROM scam_wallets)
    ORDER BY wallet LIMIT 20""")
def _(v):
    from catalog.timeseries import reviews

    latest = v.latest_scores.select(
        "wallet", F.when(F.col("is_anomalous"), F.col("score") - 5).alias("final_score"), (F.col("score") - 5).alias("score"),
        F.when(F.col("is_anomalous"), 2).alias("risk"), F.when(F.col("score") < 80, 4).alias("metadata_risk"), F.lit(False).alias("is_test_wallet"))
    return Q.publish_candidates(latest, reviews(v), v.scam_wallets, 20)
