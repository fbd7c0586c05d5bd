"""Reason and score queries over the event tables."""

from pyspark.sql import functions as F

from catalog.features import records
from catalog.registry import constant_view, query
from catalog.views import AS_OF, DAY, SQL_VIEWS
from ledgerwise import params as P
from ledgerwise.functions import scores as S
from ledgerwise.operators import drainer as D
from ledgerwise.operators import features as O
from ledgerwise.operators import graph as G
from ledgerwise.operators import reasons as R
from ledgerwise.operators import scoring as C

LATER = AS_OF + 75 * DAY  # makes about half of the reasons older than 90 days

SQL_VIEWS["w_tab"] = constant_view("code, weight", P.REASON_WEIGHTS)
SQL_VIEWS["like_tab"] = constant_view("code, factor", P.LIKELIHOODS)
SQL_VIEWS["tpl_tab"] = constant_view("code, text", P.REASON_TEMPLATES)


def sql_set(values) -> str:
    return "(" + ", ".join(f"'{x}'" for x in sorted(values)) + ")"


SQL_VIEWS["bfs_dense"] = """SELECT DISTINCT a.wallet, 0 AS d FROM adj a JOIN scam_wallets USING (wallet) UNION
    SELECT a.neighbor, d + 1 FROM bfs_dense b JOIN adj a ON a.wallet = b.wallet WHERE d < 4"""
SQL_VIEWS["clus"] = f"""SELECT n.wallet, neighbor_count, scam_neighbor_count, d AS distance_to_scam,
    CASE WHEN s.wallet IS NULL THEN 0 ELSE 1 END AS is_scam_cluster_member, ({AS_OF + 400 * DAY} - t.first_ts) // {DAY} AS wallet_age_days
    FROM (SELECT a.wallet, count(*) AS neighbor_count, count(s.wallet) AS scam_neighbor_count FROM adj a
      LEFT JOIN scam_wallets s ON s.wallet = a.neighbor GROUP BY 1) n
    JOIN (SELECT wallet, min(d) AS d FROM bfs_dense GROUP BY 1) USING (wallet)
    LEFT JOIN scam_wallets s ON s.wallet = n.wallet
    JOIN (SELECT sender AS wallet, min(ts) AS first_ts FROM transfers GROUP BY 1) t ON t.wallet = n.wallet"""


def clus(v):
    edges = G.transfer_edges(v.transfers)
    bad = v.scam_wallets
    near = G.adjacency(edges).join(
        bad.select(F.col("wallet").alias("neighbor"), F.lit(1).alias("s")), "neighbor", "left").groupBy("wallet").agg(
        F.count(F.lit(1)).alias("neighbor_count"), F.count("s").alias("scam_neighbor_count"))
    dist = G.distance_to_sources(edges, bad, max_depth=4).withColumnRenamed("distance", "distance_to_scam")
    age = v.transfers.groupBy(F.col("sender").alias("wallet")).agg(
        F.floor((F.lit(AS_OF + 400 * DAY) - F.min("ts")) / DAY).alias("wallet_age_days"))
    flag = bad.withColumn("is_scam_cluster_member", F.lit(1))
    return near.join(dist, "wallet").join(age, "wallet").join(flag, "wallet", "left").fillna(
        0, ["is_scam_cluster_member"])


def joined(v):
    return R.feature_join(clus(v), O.flow_features(v.transfers), D.drainer_features(records(v), v.wallets))


SQL_VIEWS["feat_joined"] = "SELECT * FROM clus FULL JOIN flow USING (wallet) FULL JOIN drain USING (wallet)"
_JCOLS = ("neighbor_count scam_neighbor_count distance_to_scam is_scam_cluster_member wallet_age_days total_tx "
          "unique_destinations rapid_tx_count avg_tx_interval percent_to_new_wallets tx_chain_length_estimate "
          "approval_like_count rapid_outflow_count multi_victim_pattern new_contract_interaction_count "
          "swap_then_transfer_pattern percent_to_same_cluster").split()


@query("r01_feature_join", "SELECT wallet, " + ", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in _JCOLS) +
       " FROM feat_joined")
def _(v):
    return joined(v)


SQL_VIEWS["code_lists"] = """SELECT wallet, list_filter([
    CASE WHEN scam_neighbor_count >= 1 OR coalesce(distance_to_scam, 0) <= 1 THEN 'NEAR_SCAM_CLUSTER' END,
    CASE WHEN percent_to_same_cluster >= 50 THEN 'HIGH_CLUSTER_CONTAMINATION' END,
    CASE WHEN is_scam_cluster_member = 1 THEN 'SCAM_CLUSTER_MEMBER' END,
    CASE WHEN coalesce(total_tx, 0) < 3 THEN 'NEW_WALLET' END,
    CASE WHEN coalesce(total_tx, 0) < 3 OR coalesce(unique_destinations, 0) < 2 THEN 'LOW_ACTIVITY' END,
    CASE WHEN rapid_tx_count >= 5 THEN 'HIGH_RAPID_TX' END,
    CASE WHEN percent_to_new_wallets >= 70 AND rapid_outflow_count > 0 THEN 'LARGE_OUTFLOW_TO_NEW_WALLET' END,
    CASE WHEN approval_like_count >= 1 THEN 'HIGH_APPROVAL_RISK' END,
    CASE WHEN rapid_outflow_count > 0 THEN 'SUDDEN_DRAIN_PATTERN' END,
    CASE WHEN rapid_outflow_count >= 3 THEN 'RAPID_TOKEN_DUMP' END,
    CASE WHEN multi_victim_pattern > 0 THEN 'MULTI_VICTIM_PATTERN' END,
    CASE WHEN new_contract_interaction_count > 0 THEN 'NEW_CONTRACT_INTERACTION' END,
    CASE WHEN swap_then_transfer_pattern > 0 THEN 'SWAP_THEN_TRANSFER' END,
    CASE WHEN wallet_age_days >= 365 THEN 'AGE_1Y' END,
    CASE WHEN coalesce(is_scam_cluster_member, 0) = 0 THEN 'NO_SCAM_HISTORY' END,
    CASE WHEN coalesce(is_scam_cluster_member, 0) = 0 THEN 'LOW_RISK_CLUSTER' END,
    CASE WHEN coalesce(distance_to_scam, 0) >= 3 THEN 'FAR_FROM_SCAM_CLUSTER' END,
    CASE WHEN wallet_age_days >= 365 THEN 'LONG_HISTORY' END,
    CASE WHEN is_scam_cluster_member = 1 AND coalesce(distance_to_scam, 0) < 3 AND coalesce(wallet_age_days, 0) < 365
      THEN 'CLEAN_HISTORY' END], lambda x: x IS NOT NULL) AS codes FROM feat_joined"""


@query("r02_feature_reason_codes", "SELECT wallet, array_to_string(codes, ',') AS codes FROM code_lists")
def _(v):
    return R.feature_reason_codes(joined(v)).withColumn("codes", F.array_join("codes", ","))


_W3 = {"DRAINER_INTERACTION": 0.9, "NEW_WALLET": 0.05, "RUG_PULL_DEPLOYER": 0.02, "CLEAN_HISTORY": 0.001}
SQL_VIEWS["w3_tab"] = constant_view("code, weight", _W3)
SQL_VIEWS["code_counts"] = "SELECT wallet, reason_code AS code, count(*) AS n FROM wallet_reasons GROUP BY 1, 2"


@query("r03_reason_frequency", """SELECT c.wallet, string_agg(c.code, ',' ORDER BY n DESC, c.code) AS reason_codes,
    string_agg(c.code || '=' || n, ',' ORDER BY n DESC, c.code) AS reason_freq,
    array_to_string(list(c.code ORDER BY n DESC, c.code)[1:3], ',') AS top_3,
    round(least(100.0, sum(CAST(coalesce(weight, 0.5) * n AS DECIMAL(20, 6)))::DOUBLE * 20)::DOUBLE * 100) / 100 AS weighted_risk_score
    FROM code_counts c LEFT JOIN w3_tab w ON w.code = c.code GROUP BY 1""")
def _(v):
    rows = v.wallet_reasons.select("wallet", F.col("reason_code").alias("code"))
    return R.reason_frequency(rows, _W3).withColumns({
        "reason_freq": F.array_join(F.transform(
            "reason_codes", lambda c: F.concat_ws("=", c, F.col("reason_freq")[c].cast("string"))), ","),
        "reason_codes": F.array_join("reason_codes", ","),
    })


SQL_VIEWS["ev_counts"] = "SELECT wallet, reason_code AS code, count(*) AS n FROM reason_evidence GROUP BY 1, 2"


@query("r04_evidence_summary", """SELECT wallet, string_agg(code, ',' ORDER BY n DESC, code) AS reason_codes,
    string_agg(code, ',' ORDER BY n DESC, code) AS top_reasons, CAST(sum(n * CASE code WHEN 'DRAINER_INTERACTION' THEN 20
    WHEN 'HIGH_VALUE_OUTFLOW' THEN 10 WHEN 'NEW_WALLET' THEN 5 WHEN 'LOW_ACTIVITY' THEN 3 ELSE 0 END) AS BIGINT)
    AS reason_risk_score FROM ev_counts GROUP BY 1""")
def _(v):
    return R.evidence_summary(v.reason_evidence).drop("reason_freq").withColumn(
        "reason_codes", F.array_join("reason_codes", ","))


# two codes count as no risk, so that it is dropped where a wallet has worse
SQL_VIEWS["mild"] = f"""SELECT wallet, CASE WHEN reason_code IN ('LOW_ACTIVITY', 'NEW_WALLET') THEN 'NO_RISK_DETECTED'
    ELSE reason_code END AS reason_code, confidence, tx_hash, created_at FROM wallet_reasons"""


def mild(v):
    return v.wallet_reasons.withColumn(
        "reason_code", F.when(F.col("reason_code").isin("LOW_ACTIVITY", "NEW_WALLET"), P.NO_RISK)
        .otherwise(F.col("reason_code")))


@query("r05_default_reasons", f"""WITH bad AS (SELECT DISTINCT wallet FROM mild m JOIN w_tab w ON w.code = m.reason_code WHERE weight < 0)
    SELECT wallet, reason_code AS code, confidence, tx_hash, greatest(0, ({LATER} - created_at) // {DAY}) AS days_old FROM mild
      WHERE reason_code <> 'NO_RISK_DETECTED' OR wallet NOT IN (FROM bad)
    UNION ALL SELECT wallet, 'CLEAN_HISTORY', 1.0, NULL, 0 FROM (SELECT wallet FROM mild UNION SELECT wallet FROM wallets)
      WHERE wallet NOT IN (FROM bad)""")
def _(v):
    return R.default_reasons(mild(v), v.wallets, LATER)


SQL_VIEWS["r_unique"] = """SELECT wallet, reason_code, CASE WHEN sum(weight) < 0 THEN greatest(-50, sum(weight))
    ELSE least(40, sum(weight)) END::BIGINT AS weight, max(coalesce(confidence, 0)) AS confidence,
    max(created_at) AS created_at FROM wallet_reasons
    WHERE wallet IN (SELECT wallet FROM latest_scores) GROUP BY 1, 2"""
SQL_VIEWS["r_scores"] = """SELECT u.wallet, round(greatest(0, least(100, any_value(score) + sum(weight)))::DOUBLE * 100) / 100 AS score,
    string_agg(reason_code, ',' ORDER BY reason_code) AS reason_codes FROM r_unique u JOIN latest_scores USING (wallet) GROUP BY 1"""
_RANK = "CASE WHEN score < 20 THEN '3' WHEN score < 50 THEN '2' WHEN score < 80 THEN '1' ELSE '0' END"


def unique(v):
    return R.dedupe_reasons(v.wallet_reasons, v.latest_scores)[0]


@query("r06_dedupe_reasons", "SELECT wallet, reason_code, weight, confidence FROM r_unique")
def _(v):
    return unique(v)


@query("r06_dedupe_scores", f"SELECT wallet, score, {_RANK} AS risk_level, reason_codes FROM r_scores")
def _(v):
    return R.dedupe_reasons(v.wallet_reasons, v.latest_scores)[1]


SQL_VIEWS["r_eff"] = f"""SELECT r.wallet, r.reason_code AS code, CASE WHEN {LATER} - created_at > {90 * DAY}
    THEN trunc(sw / 2.0)::INTEGER ELSE sw END AS weight,
    greatest(0, least(1, coalesce(confidence, CASE reason_code WHEN 'CLEAN_HISTORY' THEN 0.7 WHEN 'SCAM_CLUSTER_MEMBER' THEN 0.9
    ELSE 1.0 END)))::DOUBLE AS confidence, ({LATER} - created_at) // {DAY} AS days_old, created_at, tx_hash
    FROM (SELECT *, CASE WHEN reason_code IN {sql_set(P.HIGH_RISK_CODES)} THEN -abs(weight) ELSE weight END AS sw FROM wallet_reasons) r"""


def effective(v):
    return R.effective_reasons(v.wallet_reasons, LATER)


@query("r07_effective_reasons", "SELECT wallet, code, weight, confidence, days_old FROM r_eff")
def _(v):
    return effective(v)


SQL_VIEWS["w_over"] = """SELECT reason_code AS code, max(CASE WHEN weight < 0 THEN weight - 1 ELSE weight END) AS w
    FROM wallet_reasons GROUP BY 1"""


@query("r08_reason_weights", """SELECT coalesce(o.code, w.code) AS code, CAST(coalesce(o.w, w.weight) AS INTEGER) AS weight FROM w_tab w FULL JOIN
    w_over o ON o.code = w.code""")
def _(v):
    over = v.wallet_reasons.groupBy(F.col("reason_code").alias("code")).agg(
        F.max(F.when(F.col("weight") < 0, F.col("weight") - 1).otherwise(F.col("weight"))).alias("weight"))
    return R.reason_weights(v.spark, over)


# prior from the last score; codes from all reasons, each with its newest time
SQL_VIEWS["day_codes"] = f"""SELECT wallet, reason_code AS code, ({LATER} - max(created_at)) // {DAY} AS days_old FROM wallet_reasons GROUP BY 1, 2"""
SQL_VIEWS["priors"] = "SELECT wallet, (100 - score) / 100 AS prior FROM latest_scores"
SQL_VIEWS["post"] = f"""SELECT w.wallet, greatest(0.001, least(0.999, coalesce(p.prior, 0.05)))::DOUBLE AS prior, lg,
    coalesce(weak, false) AS weak FROM (SELECT wallet FROM day_codes UNION SELECT wallet FROM priors) w
    LEFT JOIN priors p USING (wallet) LEFT JOIN (SELECT wallet, sum(ln(coalesce(factor, 1.0))) AS lg,
      bool_and(d.code IN {sql_set(P.WEAK_CODES)}) AS weak FROM day_codes d LEFT JOIN like_tab l ON l.code = d.code GROUP BY 1) USING (wallet)"""
SQL_VIEWS["posterior_tab"] = """SELECT wallet, prior, CASE WHEN weak THEN prior ELSE greatest(0.001, least(0.999,
    1 / (1 + exp(-(ln(prior / (1 - prior)) + coalesce(lg, 0)))))) END AS posterior FROM post"""


def day_codes(v):
    last = v.wallet_reasons.groupBy("wallet", F.col("reason_code").alias("code")).agg(F.max("created_at").alias("at"))
    return last.select("wallet", "code", R.days_old(F.col("at"), LATER).alias("days_old"))


def priors(v):
    return v.latest_scores.select("wallet", ((100 - F.col("score")) / 100).alias("prior"))


@query("r09_bayes_posterior", "SELECT wallet, round(prior, 6) AS prior, round(posterior, 6) AS posterior FROM posterior_tab")
def _(v):
    return C.bayes_posterior(day_codes(v), priors(v)).withColumns(
        {"prior": F.round("prior", 6), "posterior": F.round("posterior", 6)})


@query("r10_bayes_update", """SELECT signature, round((l * p) / (l * p + (1 - l) * (1 - p)), 9) AS posterior FROM (
    SELECT signature, 0.001 + (amount_lamports % 997) / 1000.0::DOUBLE AS l, 0.002 + (ts % 991) / 1000.0::DOUBLE AS p FROM transfers)""")
def _(v):
    like = 0.001 + (F.col("amount_lamports") % 997) / 1000.0
    prior = 0.002 + (F.col("ts") % 991) / 1000.0
    return v.transfers.select("signature", F.round(S.bayes_update(prior, like), 9).alias("posterior"))


@query("r11_latest_prior", """SELECT wallet, arg_max((100 - score) / 100, (computed_at, (100 - score) / 100)) AS prior
    FROM score_timeline WHERE is_anomalous GROUP BY 1""")
def _(v):
    h = v.score_timeline.select("wallet", F.col("computed_at").alias("ts"),
                                F.when(F.col("is_anomalous"), (100 - F.col("score")) / 100).alias("posterior"))
    return C.latest_prior(h)


_TWP = "CASE WHEN days_old <= 0 THEN weight ELSE trunc(weight * exp(-days_old / 180.0::DOUBLE)) END"


@query("r12_time_weighted_penalty", f"SELECT wallet, CAST(sum({_TWP}) AS BIGINT) AS penalty FROM r_eff GROUP BY 1")
def _(v):
    return effective(v).groupBy("wallet").agg(
        F.sum(S.time_weighted_penalty(F.col("weight"), F.col("days_old"))).alias("penalty"))


def _conf_sql(size, scam, flow, tx, days):
    return (f"greatest(0, least(1, 0.4 * {scam} / greatest({size}, 1.0) + 0.3 * least(1.0, ln({tx} + 1) / 5) "
            f"+ 0.2 * least(1.0, ln({flow} + 1) / 5) + 0.1 * exp(-{days} / 30.0::DOUBLE)))")


SQL_VIEWS["cl_stats"] = f"""SELECT cluster_id, count(DISTINCT m.wallet) AS size, count(DISTINCT s.wallet) AS scam,
    sum(amount_lamports) / CAST(1e9 AS DOUBLE) AS flow, count(*) AS tx, ({AS_OF} - max(ts)) // {DAY} AS days
    FROM cluster_members m JOIN transfers t ON t.sender = m.wallet LEFT JOIN scam_wallets s ON s.wallet = m.wallet GROUP BY 1"""


def cl_stats(v):
    s = v.scam_wallets.withColumn("s", F.col("wallet"))
    return v.transfers.withColumn("wallet", F.col("sender")).join(v.cluster_members, "wallet").join(s, "wallet", "left").groupBy(
        "cluster_id").agg(
        F.count_distinct("wallet").alias("size"), F.count_distinct("s").alias("scam"),
        (F.sum("amount_lamports") / 1e9).alias("flow"), F.count(F.lit(1)).alias("tx"),
        F.floor((F.lit(AS_OF) - F.max("ts")) / DAY).alias("days"))


@query("r13_cluster_confidence", f"""SELECT cluster_id, round({_conf_sql('size', 'scam', 'flow', 'tx', 'days')}::DOUBLE, 6) AS confidence
    FROM cl_stats""")
def _(v):
    c = F.col
    conf = S.cluster_confidence(c("size"), c("scam"), c("flow"), c("tx"), c("days"))
    return cl_stats(v).select("cluster_id", F.round(conf, 6).alias("confidence"))


@query("r14_cluster_risk_penalty", f"""SELECT cluster_id, round(-100.0 * exp(-size / 1.5::DOUBLE) * exp(-days / 180.0::DOUBLE) *
    {_conf_sql('size', 'scam', 'flow', 'tx', 'days')}, 6)::DOUBLE AS penalty FROM cl_stats""")
def _(v):
    c = F.col
    conf = S.cluster_confidence(c("size"), c("scam"), c("flow"), c("tx"), c("days"))
    return cl_stats(v).select("cluster_id", F.round(
        S.cluster_risk_penalty(F.lit(-100.0), c("size"), c("days"), conf), 6).alias("penalty"))


SQL_VIEWS["dyn_feat"] = """SELECT sender AS wallet, count(DISTINCT receiver) AS cluster_size,
    sum(amount_lamports) / CAST(1e9 AS DOUBLE) AS flow_amount, count(*) AS tx_count FROM transfers GROUP BY 1"""


def dyn_feat(v):
    return v.transfers.groupBy(F.col("sender").alias("wallet")).agg(
        F.count_distinct("receiver").alias("cluster_size"), (F.sum("amount_lamports") / 1e9).alias("flow_amount"),
        F.count(F.lit(1)).alias("tx_count"))


_DYN = """SELECT r.wallet, CASE WHEN bool_or(code IN {trig}) AND bool_or(weight < 0) THEN
    CAST(trunc(greatest(-100, least(100, sum({twp}) + coalesce(sum(CAST(CASE WHEN code = 'SCAM_CLUSTER_MEMBER' THEN
      -100.0 * exp(-{dist} / 1.5::DOUBLE) * exp(-days_old / 180.0::DOUBLE) * {conf} END AS DECIMAL(28, 9))), 0)::DOUBLE))) AS INTEGER) ELSE 0 END AS penalty
    FROM {r} r LEFT JOIN dyn_feat f ON f.wallet = r.wallet {extra} GROUP BY 1"""
_C15 = _conf_sql("coalesce(nullif(f.cluster_size, 0), 1)", "1", "coalesce(f.flow_amount, 0)", "0", "0")
SQL_VIEWS["dyn_pen"] = _DYN.format(trig=sql_set(P.SCAM_TRIGGERS), twp=_TWP, conf=_C15, r="r_eff", dist="1", extra="")


@query("r15_dynamic_penalty", "SELECT * FROM dyn_pen")
def _(v):
    return C.dynamic_penalty(effective(v).withColumn("graph_distance", F.lit(1)), dyn_feat(v))


@query("r16_dynamic_risk_simple", f"""SELECT wallet, CASE WHEN bool_or(code IN {sql_set(P.SCAM_TRIGGERS)}) AND bool_or(weight < 0)
    THEN CAST(least(60, greatest(0, -sum({_TWP}))) AS INTEGER) ELSE 0 END AS penalty FROM r_eff GROUP BY 1""")
def _(v):
    return C.dynamic_risk_simple(effective(v))


SQL_VIEWS["hop_scam"] = """SELECT wallet, min(h) AS h FROM (SELECT wallet, 1 AS h FROM adj WHERE neighbor IN (FROM scam_wallets)
    UNION ALL SELECT x.wallet, 2 FROM adj x JOIN adj y ON y.wallet = x.neighbor WHERE y.neighbor IN (FROM scam_wallets)
      AND y.neighbor <> x.wallet) GROUP BY 1"""
SQL_VIEWS["dyn2"] = f"""SELECT s.wallet, CASE WHEN NOT is_anomalous THEN score ELSE 0.6 * (score / 2) + 0.4 * score END AS updated,
    CASE h WHEN 1 THEN -30.0 WHEN 2 THEN -15.0 ELSE 0.0 END AS graph_penalty,
    -2.0 * (({AS_OF} - last_tx) // {DAY}) AS decay, 2.0 * tx24 AS activity_boost, rp FROM latest_scores s
    JOIN (SELECT wallet, max(ts) AS last_tx, count(*) FILTER (ts > {AS_OF - DAY}) AS tx24 FROM ends GROUP BY 1) e USING (wallet)
    LEFT JOIN hop_scam USING (wallet) LEFT JOIN (SELECT wallet,
      sum(CAST(weight * coalesce(confidence, 1.0) AS DECIMAL(28, 9)))::DOUBLE AS rp FROM wallet_reasons GROUP BY 1) USING (wallet)"""


@query("r17_dynamic_risk_v2", """SELECT wallet, round(updated, 6) AS updated, graph_penalty::DOUBLE AS graph_penalty, decay::DOUBLE AS decay,
    activity_boost::DOUBLE AS activity_boost, round(dr, 6) AS dynamic_risk, round(rp, 6) AS reason_penalty,
    round(greatest(0, least(100, dr + rp)), 6)::DOUBLE AS final_score FROM (SELECT *, greatest(0, least(100,
      updated + graph_penalty + decay + activity_boost))::DOUBLE AS dr FROM dyn2)""")
def _(v):
    s = v.latest_scores.select("wallet", F.col("score").alias("ml_score"),
                               F.when(F.col("is_anomalous"), F.col("score") / 2).alias("prior"))
    out = C.dynamic_risk_v2(s, v.wallet_reasons, v.transfers, v.scam_wallets, AS_OF)
    return out.select("wallet", *[F.round(c, 6).alias(c) for c in out.columns if c != "wallet"])


SQL_VIEWS["fs_in"] = f"""SELECT s.wallet, score AS ml_score, (100 - score) / 200 AS scam_prob, c.cluster_id % 3 AS n_tokens,
    ({AS_OF} - t.first_ts) // {DAY} AS age, CASE WHEN is_anomalous THEN ({AS_OF} - s.computed_at) // {DAY} ELSE 9999 END AS scam_days, d, cluster_size,
    flow_amount, tx_count FROM latest_scores s JOIN cluster_members c USING (wallet) JOIN dyn_feat USING (wallet)
    JOIN (SELECT sender AS wallet, min(ts) AS first_ts FROM transfers GROUP BY 1) t USING (wallet)
    LEFT JOIN (SELECT wallet, min(d) AS d FROM bfs_dense GROUP BY 1) USING (wallet)"""
SQL_VIEWS["fs_codes"] = f"""SELECT d.wallet, d.code, min(days_old) AS days_old, any_value(CASE WHEN d.code IN {sql_set(P.FORCED_NEGATIVE_CODES)}
    THEN -abs(coalesce(w.weight, 0)) ELSE coalesce(w.weight, 0) END) AS weight FROM day_codes d LEFT JOIN w_tab w ON w.code = d.code GROUP BY 1, 2"""
SQL_VIEWS["fs_dyn"] = _DYN.format(trig=sql_set(P.SCAM_TRIGGERS), twp=_TWP, conf=_C15, r="fs_codes", dist="any_value_d", extra="").replace(
    "any_value_d", "coalesce(b.d, 999)").replace("GROUP BY 1", "", 1).replace(
    "LEFT JOIN dyn_feat f ON f.wallet = r.wallet", "LEFT JOIN dyn_feat f ON f.wallet = r.wallet LEFT JOIN fs_in b ON b.wallet = r.wallet") + " GROUP BY 1"
SQL_VIEWS["fs_1"] = """SELECT i.*, ml_eff AS base, p, n, codes, dyn, CASE WHEN posterior IS NULL THEN 0.05 ELSE posterior END AS post,
    ml_eff + p AS adj_base FROM (SELECT *, CASE WHEN (age = 0 AND tx_count = 0) OR (scam_prob < 0.05 AND n_tokens <= 1) THEN 50.0 ELSE ml_score END AS ml_eff FROM fs_in) i
    JOIN (SELECT wallet, least(40, coalesce(sum(weight) FILTER (weight > 0), 0)) AS p, coalesce(sum(weight) FILTER (weight < 0), 0) AS n,
      list(code) AS codes FROM fs_codes GROUP BY 1) USING (wallet)
    JOIN (SELECT wallet, penalty AS dyn FROM fs_dyn) USING (wallet) LEFT JOIN posterior_tab USING (wallet)"""
SQL_VIEWS["fs_2"] = """SELECT *, CAST(trunc(adj_base - least(adj_base * least(abs(n) / 100.0::DOUBLE, 0.9::DOUBLE), 0.7::DOUBLE * adj_base)) AS BIGINT) AS after_reasons FROM fs_1"""
SQL_VIEWS["fs_3"] = """SELECT *, greatest(0, least(100, after_reasons + dyn - CAST(trunc(post * 100) AS BIGINT))) AS after_risk FROM fs_2"""
SQL_VIEWS["fs_4"] = """SELECT *, least(after_risk, CASE WHEN codes = ['CLEAN_HISTORY'] THEN 80 ELSE 100 END,
    CASE WHEN list_contains(codes, 'NEW_WALLET') THEN 60 ELSE 100 END, CASE WHEN list_contains(codes, 'LOW_ACTIVITY') THEN 70 ELSE 100 END) AS capped FROM fs_3"""
SQL_VIEWS["fs_5"] = """SELECT *, greatest(0, least(100, capped + CASE WHEN age > 365 THEN 20 WHEN age > 180 THEN 10 WHEN age > 90 THEN 5 ELSE 0 END
    + CASE WHEN scam_days < 7 THEN -30 WHEN scam_days < 30 THEN -15 WHEN scam_days < 90 THEN -5 ELSE 0 END)) AS after_age FROM fs_4"""
SQL_VIEWS["fs_6"] = """SELECT *, CAST(greatest(0, least(100, after_age + CASE coalesce(d, 999) WHEN 0 THEN -100 WHEN 1 THEN -60 WHEN 2 THEN -30
    WHEN 3 THEN -10 ELSE 0 END)) AS INTEGER) AS final_score FROM fs_5"""


def fs_inputs(v):
    s = v.latest_scores.join(v.cluster_members, "wallet")
    ml = s.select("wallet", F.col("score").alias("ml_score"), ((100 - F.col("score")) / 200).alias("scam_prob"),
                  (F.col("cluster_id") % 3).alias("n_tokens"))
    first = v.transfers.groupBy(F.col("sender").alias("wallet")).agg(F.min("ts").alias("f"))
    dist = G.distance_to_sources(G.transfer_edges(v.transfers), v.scam_wallets, max_depth=4).filter("distance >= 0")
    meta = v.latest_scores.join(first, "wallet").join(dist, "wallet", "left").select(
        "wallet", F.floor((F.lit(AS_OF) - F.col("f")) / DAY).alias("wallet_age_days"),
        F.when(F.col("is_anomalous"), F.floor((F.lit(AS_OF) - F.col("computed_at")) / DAY)).otherwise(9999).alias("last_scam_days"),
        F.col("distance").alias("graph_distance"))
    return ml, meta


@query("r18_final_score", """SELECT wallet, base, p::BIGINT AS positive, n::BIGINT AS negative, after_reasons, dyn AS dynamic_penalty, round(post, 6) AS posterior,
    after_risk, capped, after_age, final_score, CASE WHEN final_score <= 25 THEN 'HIGH' WHEN final_score <= 50 THEN 'MEDIUM' WHEN final_score <= 75 THEN 'LOW' ELSE 'SAFE' END AS risk
    FROM fs_6""")
def _(v):
    ml, meta = fs_inputs(v)
    return C.final_score(ml, day_codes(v), priors(v), meta, dyn_feat(v)).drop("risk_level").withColumn(
        "posterior", F.round("posterior", 6))


@query("r19_reputation_decay", """SELECT wallet, age + 80 AS age, CAST(capped AS BIGINT) AS capped, CAST(greatest(0, least(100, capped + a)) AS BIGINT) AS score, a AS adjustment FROM (
    SELECT *, CASE WHEN age + 80 > 365 THEN 20 WHEN age + 80 > 180 THEN 10 WHEN age + 80 > 90 THEN 5 ELSE 0 END +
    CASE WHEN scam_days < 7 THEN -30 WHEN scam_days < 30 THEN -15 WHEN scam_days < 90 THEN -5 ELSE 0 END AS a FROM
    (SELECT wallet, age, scam_days, CAST(trunc(ml_score) AS BIGINT) AS capped FROM fs_in))""")
def _(v):
    ml, meta = fs_inputs(v)
    df = ml.join(meta, "wallet").select("wallet", (F.col("wallet_age_days") + 80).alias("age"), "last_scam_days",
                                        F.col("ml_score").cast("bigint").alias("capped"))
    r = S.reputation_decay(F.col("capped"), F.col("age"), F.col("last_scam_days"))
    return df.select("wallet", "age", "capped", r["score"].alias("score"), r["adjustment"].alias("adjustment"))


@query("r20_graph_penalty", """SELECT wallet, CAST(greatest(0, least(100, trunc(ml_score) + a)) AS BIGINT) AS score, a AS adjustment FROM (
    SELECT *, CASE coalesce(d, 999) WHEN 0 THEN -100 WHEN 1 THEN -60 WHEN 2 THEN -30 WHEN 3 THEN -10 ELSE 0 END AS a FROM fs_in)""")
def _(v):
    ml, meta = fs_inputs(v)
    r = S.graph_penalty(F.col("ml_score").cast("bigint"), F.coalesce("graph_distance", F.lit(999)))
    return ml.join(meta, "wallet").select("wallet", r["score"].alias("score"), r["adjustment"].alias("adjustment"))


SQL_VIEWS["sus_set"] = f"""SELECT wallet FROM scam_wallets UNION SELECT wallet FROM wallet_reasons
    WHERE reason_code IN {sql_set(P.CLUSTER_CODES)}"""
MUCH_LATER = LATER + 45 * DAY


@query("r21_score_recovery", f"""WITH lt AS (SELECT w, max(ts) AS ts FROM (
      SELECT unnest([sender, receiver]) AS w, ts FROM transfers WHERE sender IN (FROM sus_set) OR receiver IN (FROM sus_set)) GROUP BY 1),
    lr AS (SELECT wallet AS w, max(created_at) FILTER (reason_code IN {sql_set(P.SUSPICIOUS_CODES)}) AS rts,
      bool_and(reason_code IN {sql_set(P.CLEAN_CODES)}) AS clean FROM wallet_reasons GROUP BY 1),
    x AS (SELECT s.wallet, CAST(trunc(score) AS INTEGER) AS old, ({MUCH_LATER} - coalesce(ts, rts)) / {DAY}::DOUBLE AS days, clean
      FROM latest_scores s LEFT JOIN lt ON lt.w = s.wallet LEFT JOIN lr ON lr.w = s.wallet)
    SELECT wallet, old, new, CAST(floor(days) AS BIGINT) AS days_clean, CASE WHEN new < 40 THEN 'high' WHEN new < 70 THEN 'medium' ELSE 'low' END AS risk_level
    FROM (SELECT *, greatest(0, least(CASE WHEN clean THEN 100 ELSE 80 END, old + CASE WHEN days >= 90 THEN 20 WHEN days >= 60 THEN 10
      WHEN days >= 30 THEN 5 ELSE 0 END)) AS new FROM x WHERE days IS NOT NULL) WHERE new > old AND days >= 30""")
def _(v):
    return C.score_recovery(v.latest_scores, v.transfers, v.wallet_reasons, v.scam_wallets, [], MUCH_LATER)


@query("r22_combine_scores", """SELECT s.wallet, round(f * 100) / 100 AS score, CASE WHEN f > 80 THEN 'LOW' WHEN f >= 50 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
    coalesce(reason_codes, '') AS reason_codes FROM (SELECT wallet, greatest(0.0, least(100.0, score - coalesce(pen, 0)))::DOUBLE AS f FROM latest_scores
      LEFT JOIN (SELECT wallet, -min(penalty) AS pen FROM dyn_pen WHERE penalty < 0 GROUP BY 1) USING (wallet)) s LEFT JOIN r_scores r ON r.wallet = s.wallet""")
def _(v):
    pen = C.dynamic_penalty(effective(v).withColumn("graph_distance", F.lit(1)), dyn_feat(v)).filter("penalty < 0").select(
        "wallet", (-F.col("penalty")).alias("penalty_score"))
    ml = v.latest_scores.select("wallet", F.col("score").alias("ml_score"))
    return C.combine_scores(ml, pen, R.dedupe_reasons(v.wallet_reasons, v.latest_scores)[1])


@query("r23_capped_reason_score", """SELECT s.wallet, greatest(0.0, least(100.0, score + least(40, p) + n))::DOUBLE AS score FROM latest_scores s
    JOIN (SELECT wallet, coalesce(sum(weight) FILTER (weight > 0), 0) AS p, coalesce(sum(weight) FILTER (weight < 0), 0) AS n FROM fs_codes GROUP BY 1) USING (wallet)""")
def _(v):
    w = S.forced_weight(F.col("code"), F.coalesce(R.lookup(P.REASON_WEIGHTS, F.col("code")), F.lit(0)))
    rows = day_codes(v).select("wallet", "code").distinct().withColumn("weight", w)
    return C.capped_reason_score(v.latest_scores, rows).withColumn("score", F.col("score"))


@query("r24_risk_level", """SELECT id, CASE WHEN score <= 25 THEN 'HIGH' WHEN score <= 50 THEN 'MEDIUM' WHEN score <= 75 THEN 'LOW' ELSE 'SAFE' END AS label,
    CASE WHEN score < 20 THEN '3' WHEN score < 50 THEN '2' WHEN score < 80 THEN '1' ELSE '0' END AS rank_low_good,
    CASE WHEN score <= 25 THEN '3' WHEN score <= 50 THEN '2' WHEN score <= 75 THEN '1' ELSE '0' END AS rank_bands,
    CASE WHEN score < 30 THEN 'critical' WHEN score < 50 THEN 'high' WHEN score < 70 THEN 'medium' ELSE 'low' END AS oracle,
    CASE WHEN score >= 70 THEN 'low' WHEN score >= 40 THEN 'medium' ELSE 'high' END AS recovery,
    CASE WHEN score < 34 THEN 'HIGH' WHEN score < 67 THEN 'MEDIUM' ELSE 'LOW' END AS model FROM score_timeline""")
def _(v):
    return v.score_timeline.select("id", *[S.risk_level(F.col("score"), s).alias(s) for s in (
        "label", "rank_low_good", "rank_bands", "oracle", "recovery", "model")])


@query("r24_risk_level_from_reasons", f"""SELECT wallet, CASE WHEN bool_or(code IN {sql_set(P.CRITICAL_CODES)}) THEN 'critical' WHEN min(weight) < -50 THEN 'high'
    WHEN min(weight) < -20 THEN 'medium' ELSE 'low' END AS risk_level FROM fs_codes GROUP BY 1""")
def _(v):
    w = S.forced_weight(F.col("code"), F.coalesce(R.lookup(P.REASON_WEIGHTS, F.col("code")), F.lit(0)))
    g = day_codes(v).withColumn("w", w).groupBy("wallet").agg(F.collect_set("code").alias("c"), F.min("w").alias("m"))
    return g.select("wallet", S.risk_level_from_reasons(F.col("c"), F.col("m")).alias("risk_level"))


def _bands(rows) -> str:
    return "CASE " + " ".join(f"WHEN score >= {lo} THEN '{name}'" for lo, name, _ in rows) + " END"


def _colors(rows) -> str:
    return "CASE " + " ".join(f"WHEN score >= {lo} THEN '{color}'" for lo, _, color in rows) + " END"


BADGE5 = _bands(P.BADGE_FIVE)


@query("r25_badge", f"""SELECT id, {BADGE5} AS five, {_colors(P.BADGE_FIVE)} AS five_color, {_bands(P.BADGE_FOUR)} AS four,
    {_colors(P.BADGE_FOUR)} AS four_color, {_bands(P.BADGE_TRANSFER)} AS transfer FROM score_timeline""")
def _(v):
    five, four = S.badge(F.col("score"), "five"), S.badge(F.col("score"), "four")
    return v.score_timeline.select(
        "id", five["name"].alias("five"), five["color"].alias("five_color"), four["name"].alias("four"),
        four["color"].alias("four_color"), S.badge(F.col("score"), "transfer")["name"].alias("transfer"))


@query("r26_badge_changes", f"""SELECT wallet, badge, computed_at AS ts FROM (SELECT *, lag(badge) OVER (PARTITION BY wallet
    ORDER BY computed_at, id) AS before FROM (SELECT *, {BADGE5} AS badge FROM score_timeline)) WHERE badge IS DISTINCT FROM before""")
def _(v):
    return C.badge_changes(v.score_timeline)


@query("r27_badge_timeline", f"""WITH h AS (SELECT wallet, computed_at AS ts, CASE WHEN is_anomalous THEN (1 - score / 200) * 100 ELSE score END AS score
      FROM score_timeline), l AS (SELECT wallet, arg_max(round(score), (ts, score)) AS last FROM h GROUP BY 1)
    SELECT wallet, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M') AS "date", {BADGE5} AS badge, CAST(round(score) AS INTEGER) AS score
    FROM (SELECT * FROM h UNION ALL SELECT s.wallet, {AS_OF}, s.score FROM latest_scores s LEFT JOIN l ON l.wallet = s.wallet
      WHERE last IS NULL OR abs(last - s.score) > 0.5)""")
def _(v):
    h = v.score_timeline.select("wallet", F.when(~F.col("is_anomalous"), F.col("score")).alias("score"),
                                (F.col("score") / 200).alias("posterior"), F.col("computed_at").alias("snapshot_at"))
    return C.badge_timeline(h, v.latest_scores, AS_OF)


SQL_VIEWS["expl"] = """SELECT u.wallet, row_number() OVER (PARTITION BY u.wallet ORDER BY abs(weight) DESC, reason_code) AS rank, reason_code AS code,
    coalesce(t.text, '[' || reason_code || ']') AS text, round(confidence * 100) / 100 AS confidence, weight FROM r_unique u LEFT JOIN tpl_tab t ON t.code = u.reason_code"""


def expl(v):
    return R.explanations(unique(v))


@query("r28_explanations", "SELECT wallet, rank, code, text, confidence FROM expl")
def _(v):
    return expl(v)


_FINAL = "CASE code " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in P.FINAL_PHRASES.items())
_TITLE = ("array_to_string(list_transform(string_split(code, '_'), lambda s: upper(s[1]) || lower(s[2:])), ' ')")
for _variant, _sql in {
    "explanations": """SELECT wallet, CASE WHEN count(*) = 1 THEN max(t) ELSE max(t) FILTER (rank = 1) || ' and ' ||
        max(lower(t[1]) || t[2:]) FILTER (rank = 2) END AS summary FROM (SELECT wallet, rank, CASE WHEN text LIKE 'This wallet %' THEN 'Wallet ' || text[13:]
        ELSE text END AS t FROM expl WHERE rank <= 2) GROUP BY 1""",
    "phrases": """SELECT wallet, CASE WHEN count(ng) > 0 THEN 'Wallet ' || string_agg(ng, ', ' ORDER BY rank) || '.' WHEN count(ps) > 0
        THEN 'Wallet ' || string_agg(ps, ', ' ORDER BY rank) || '.' ELSE 'No significant activity detected.' END AS summary FROM (
        SELECT wallet, rank, CASE code """ + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in P.NEGATIVE_PHRASES.items()) + """ END AS ng,
        CASE code """ + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in P.POSITIVE_PHRASES.items()) + " END AS ps FROM expl) GROUP BY 1",
    "codes": """SELECT wallet, CASE WHEN count(*) FILTER (weight < 0) > 0 THEN 'Wallet flagged for: ' ||
        array_to_string((list(code ORDER BY rank) FILTER (weight < 0))[1:3], ', ') || '. Trust score reduced.' WHEN count(*) FILTER (weight > 0) > 0
        THEN 'Wallet shows positive signals: ' || array_to_string((list(code ORDER BY rank) FILTER (weight > 0))[1:3], ', ') || '.'
        ELSE 'No strong signals.' END AS summary FROM expl GROUP BY 1""",
    "final": f"SELECT wallet, string_agg({_FINAL} ELSE {_TITLE} END, ', ' ORDER BY rank) || '.' AS summary FROM expl GROUP BY 1",
}.items():
    def _run(v, variant=_variant):
        rows = expl(v)
        if variant == "codes":
            rows = rows.join(unique(v).select("wallet", F.col("reason_code").alias("code"), "weight"), ["wallet", "code"])
        return R.reason_summary(rows, variant)

    query(f"r29_reason_summary_{_variant}", _sql)(_run)


@query("r30_badge_card", f"""WITH t AS (SELECT wallet, string_agg(code, ',' ORDER BY rank) AS codes, list(text ORDER BY rank) AS texts FROM expl WHERE rank <= 3 GROUP BY 1),
    s AS (SELECT wallet, round(score * 100) / 100 AS score, {_RANK} AS risk FROM latest_scores)
    SELECT s.wallet, score, risk, CASE risk WHEN '0' THEN 'Low Risk' WHEN '1' THEN 'Moderate Risk' WHEN '2' THEN 'High Risk' ELSE 'Critical Risk' END AS risk_level_text,
    {_bands(P.BADGE_FOUR)} AS badge, {_colors(P.BADGE_FOUR)} AS color, codes AS top_reasons, texts[1] AS message,
    {_bands(P.BADGE_FOUR)} || ' — ' || replace(texts[1], 'This wallet ', '') || coalesce(' and ' || replace(texts[2], 'This wallet ', ''), '') AS summary
    FROM s JOIN t USING (wallet)""")
def _(v):
    s = v.latest_scores.select("wallet", "score", S.risk_level(F.col("score"), "rank_low_good").alias("risk"))
    return R.badge_card(s, unique(v)).withColumn("top_reasons", F.array_join("top_reasons", ","))


@query("r31_label_scores", """SELECT tx_hash AS wallet, CASE reason_code WHEN 'NEW_WALLET' THEN 80 WHEN 'DRAINER_INTERACTION' THEN 40 WHEN 'SCAM_CLUSTER_MEMBER' THEN 10
    ELSE 50 END AS score, CASE reason_code WHEN 'NEW_WALLET' THEN 1 WHEN 'DRAINER_INTERACTION' THEN 3 WHEN 'SCAM_CLUSTER_MEMBER' THEN 5 ELSE 2 END AS risk FROM wallet_reasons""")
def _(v):
    return R.label_scores(v.wallet_reasons.select(F.col("tx_hash").alias("wallet"), F.col("reason_code").alias("label")))


@query("r32_force_scam_scores", f"""SELECT coalesce(s.wallet, b.wallet) AS wallet, CASE WHEN b.wallet IS NOT NULL THEN 0 ELSE score END AS score,
    CASE WHEN b.wallet IS NOT NULL THEN 'HIGH' ELSE {_RANK} END AS risk_level, CASE WHEN b.wallet IS NULL THEN reason_codes WHEN coalesce(trim(reason_codes), '') = ''
    THEN 'scam_wallet' ELSE reason_codes || ',scam_wallet' END AS reason_codes, CASE WHEN b.wallet IS NULL THEN {AS_OF - 5} ELSE {AS_OF} END AS updated_at
    FROM r_scores s FULL JOIN scam_wallets b ON b.wallet = s.wallet""")
def _(v):
    s = R.dedupe_reasons(v.wallet_reasons, v.latest_scores)[1].withColumn("updated_at", F.lit(AS_OF - 5))
    return C.force_scam_scores(s, v.scam_wallets, AS_OF)


@query("r33_fill_missing_scores", f"""SELECT wallet, score, computed_at AS updated_at FROM latest_scores UNION ALL
    SELECT DISTINCT counterparty, 50.0, {AS_OF} FROM reason_evidence WHERE counterparty NOT IN (SELECT wallet FROM latest_scores)""")
def _(v):
    s = v.latest_scores.withColumnRenamed("computed_at", "updated_at")
    return C.fill_missing_scores(s, v.reason_evidence.select(F.col("counterparty").alias("wallet"), "reason_code"), AS_OF)


@query("r34_replace_reasons", f"""WITH sel AS (SELECT wallet FROM wallets WHERE wallet NOT IN (SELECT wallet FROM latest_scores WHERE is_anomalous)),
    f AS (SELECT wallet, reason_code, arg_min(tx_signature, ("timestamp", tx_signature)) AS tx_hash FROM reason_evidence WHERE wallet IN (FROM sel) AND wallet NOT IN (FROM scam_wallets) GROUP BY 1, 2)
    SELECT wallet, reason_code, weight, confidence, tx_hash, created_at FROM r_old WHERE wallet NOT IN (FROM sel)
    UNION ALL SELECT wallet, reason_code, coalesce(weight, 0), 1.0, tx_hash, {AS_OF} FROM f LEFT JOIN w_tab ON code = reason_code
    UNION ALL SELECT wallet, 'NO_RISK_DETECTED', 0, 1.0, NULL, {AS_OF} FROM sel WHERE wallet NOT IN (SELECT wallet FROM f)""")
def _(v):
    sel = v.wallets.join(v.latest_scores.filter("is_anomalous"), "wallet", "left_anti")
    ev = v.reason_evidence.join(v.scam_wallets, "wallet", "left_anti")
    return R.replace_reasons(v.wallet_reasons, ev, sel, AS_OF)


SQL_VIEWS["r_old"] = "SELECT * FROM wallet_reasons"
