"""Label, training, prediction and tuning queries."""

import uuid

from pyspark.sql import functions as F

from catalog.analysis import analysis
from catalog.graph import und_six
from catalog.reasons import clus, records
from catalog.registry import query
from catalog.views import AS_OF, AS_OF_ORDERS, DAY, SQL_VIEWS
from ledgerwise import params as P
from ledgerwise.functions import scores as S
from ledgerwise.functions.storage import by_wallet, shared_dir
from ledgerwise.operators import analysis as A
from ledgerwise.operators import drainer as D
from ledgerwise.operators import features as O
from ledgerwise.operators import ml as M


def labels_in(v):
    """Three label sources over the event wallets, with conflicts."""
    auto = v.wallet_reasons.groupBy("wallet").agg(F.max_by("reason_code", F.struct("created_at", "tx_hash")).alias("c")).select(
        "wallet", F.when(F.col("c") == "DRAINER_INTERACTION", " Phishing ").when(F.col("c") == "NEW_WALLET", "unknown").otherwise("good").alias("label"))
    manual = v.latest_scores.select("wallet", F.when(F.col("score") < 30, "rugpull").otherwise("good").alias("label"))
    return auto, manual, v.scam_wallets.withColumn("label", F.lit("SCAM"))


SQL_VIEWS["labels_merged"] = """SELECT wallet, arg_min(lbl, (NOT is_scam, rk)) AS label FROM (SELECT wallet, rk, lower(trim(l)) IN ('phishing', 'rugpull', 'scam') AS is_scam,
    CASE WHEN lower(trim(l)) = 'scam' THEN 'scam' WHEN lower(trim(l)) IN ('phishing', 'rugpull') THEN trim(l) ELSE 'good' END AS lbl FROM (
    SELECT wallet, 0 AS rk, CASE arg_max(reason_code, (created_at, tx_hash)) WHEN 'DRAINER_INTERACTION' THEN ' Phishing ' WHEN 'NEW_WALLET' THEN 'unknown' ELSE 'good' END AS l FROM wallet_reasons GROUP BY 1
    UNION ALL SELECT wallet, 1, CASE WHEN score < 30 THEN 'rugpull' ELSE 'good' END FROM latest_scores UNION ALL SELECT wallet, 2, 'SCAM' FROM scam_wallets)) GROUP BY 1"""


def merged(v):
    return M.merge_labels(*labels_in(v))


@query("m01_merge_labels", "SELECT * FROM labels_merged")
def _(v):
    return merged(v)


SQL_VIEWS["order_labels"] = "SELECT 'C' || c_custkey AS wallet, CASE WHEN c_acctbal < 0 THEN 'scam' ELSE 'good' END AS label FROM customer"


def order_labels(v):
    return v.table("customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("wallet"),
                                      F.when(F.col("c_acctbal") < 0, "scam").otherwise("good").alias("label"))


@query("m02_training_set", """SELECT l.wallet, CAST(label = 'good' AS INTEGER) AS label, round(wallet_age_days, 6) AS wallet_age_days, tx_count, unique_programs, token_accounts, scam_interactions,
    rugpull_interactions, wallet_type_encoded, scam_cluster_flag FROM order_labels l JOIN norm_f USING (wallet)""")
def _(v):
    rows = M.training_set(order_labels(v), A.normalized_features(analysis(v)))[0]
    return rows.select("wallet", "label", F.round("wallet_age_days", 6).alias("wallet_age_days"), "tx_count", "unique_programs",
                       "token_accounts", "scam_interactions", "rugpull_interactions", "wallet_type_encoded", "scam_cluster_flag")


@query("m02_training_counts", "SELECT count(n.wallet) AS valid, count(*) - count(n.wallet) AS skipped FROM order_labels l LEFT JOIN metrics n USING (wallet)")
def _(v):
    return M.training_set(order_labels(v), A.normalized_features(analysis(v)))[1]


@query("m03_score_class", "SELECT id, CASE WHEN score < 34 THEN 0 WHEN score < 67 THEN 1 ELSE 2 END AS class FROM score_timeline")
def _(v):
    return v.score_timeline.select("id", S.score_class(F.col("score")).alias("class"))


def merged_features(v):
    return M.feature_merge(clus(v), O.flow_features(v.transfers), D.drainer_features(records(v), v.wallets))


@query("m04_feature_merge", """SELECT wallet, neighbor_count::DOUBLE AS neighbor_count, scam_neighbor_count::DOUBLE AS scam_neighbor_count, distance_to_scam::DOUBLE AS distance_to_scam,
    coalesce(total_tx, 0)::DOUBLE AS total_tx, coalesce(rapid_tx_count, 0)::DOUBLE AS rapid_tx_count, coalesce(rapid_outflow_count, 0)::DOUBLE AS rapid_outflow_count FROM clus LEFT JOIN flow USING (wallet) LEFT JOIN drain USING (wallet)""")
def _(v):
    return merged_features(v).select("wallet", "neighbor_count", "scam_neighbor_count", "distance_to_scam", "total_tx",
                                     "rapid_tx_count", "rapid_outflow_count")


_PROF = """SELECT '{c}' AS "column", count(*) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max", count(*) - count({c}) AS missing,
    round(100.0 * (count(*) - count({c})) / count(*)::DOUBLE, 6)::DOUBLE AS missing_pct, concat_ws(';', CASE WHEN stddev_pop({c}) < 1e-9 THEN 'zero variance' END, CASE WHEN 100.0 * (count(*) - count({c})) / count(*) > 10 THEN 'missing values' END) AS warnings FROM prof_in"""
SQL_VIEWS["prof_in"] = "SELECT score, CASE WHEN is_anomalous THEN score END AS part, 1 AS same, is_anomalous::INT AS label FROM score_timeline"


@query("m05_dataset_profile", " UNION ALL ".join(_PROF.format(c=c) for c in ("score", "part", "same")) + """ UNION ALL SELECT 'class:' || label, n, NULL, NULL, NULL, NULL, 0, 0.0,
    CASE WHEN max(n) OVER () / min(n) OVER () > 2 THEN 'class imbalance' ELSE '' END FROM (SELECT label, count(*) AS n FROM prof_in GROUP BY 1)""")
def _(v):
    df = v.score_timeline.select("score", F.when(F.col("is_anomalous"), F.col("score")).alias("part"), F.lit(1).alias("same"),
                                 F.col("is_anomalous").cast("int").alias("label"))
    return M.dataset_profile(df, "label").withColumns({
        "warnings": F.array_join("warnings", ";"), "mean": F.round("mean", 6), "std": F.round("std", 6), "missing_pct": F.round("missing_pct", 6)})


def order_training(v):
    return M.training_set(order_labels(v), A.normalized_features(analysis(v)))[0].persist()


@query("m06_train_trust_model")
def _(v):
    return M.train_trust_model(order_training(v)).importances


@query("m06_trust_model_metrics")
def _(v):
    """With the flow and drainer features of the same customers merged in."""
    records = O.wallet_records(v.transfers_large).withColumns({
        "approval_like": F.col("program_id") == "RF", "has_swap": F.col("program_id") == "AF"})
    rows = order_training(v)
    with by_wallet(records.select(*D.RECORD)) as split:  # both kinds of features read the same records
        flow, drainer = O.flow_features(v.transfers_large, split=split), D.drainer_features(records, rows.select("wallet"), split)
    return M.train_trust_model(rows, flow, drainer).metrics


def event_rows(v):
    p = v.latest_scores.select("wallet", ((100 - F.col("score")) / 100).alias("scam_probability"))
    f = merged_features(v)
    return f.join(p, "wallet").persist(), [c for c in f.columns if c != "wallet"]


@query("m07_train_scam_model")
def _(v):
    rows, cols = event_rows(v)
    return M.train_scam_model(rows, cols).importances


@query("m08_token_training_rows", """SELECT mint, (mint_authority IS NOT NULL)::INT AS mint_authority_exists, (freeze_authority IS NOT NULL)::INT AS freeze_authority_exists, metadata_missing::INT AS metadata_missing, decimals, supply,
    (mint_authority IS NOT NULL OR freeze_authority IS NOT NULL OR metadata_missing OR coalesce(list_has_any(creator_wallets, (SELECT list(wallet) FROM scam_suppliers)), false))::INT AS label FROM tokens""")
def _(v):
    return M.token_training_rows(flagged_tokens(v), v.scam_suppliers)


def flagged_tokens(v):
    return A.token_features(v.tokens).withColumn("creator_wallets", F.split("creator_wallets", ";"))


@query("m08_train_token_model")
def _(v):
    return M.train_token_model(flagged_tokens(v), v.scam_suppliers).importances


@query("m09_train_label_classifier")
def _(v):
    return M.train_label_classifier(A.basic_ml_features(v.tx_raw, AS_OF_ORDERS).persist(), order_labels(v)).metrics


@query("m10_expected_score", """SELECT id, round((p0 * 16.5 + p1 * 50 + p2 * 83.5) / (p0 + p1 + p2), 9)::DOUBLE AS expected FROM (SELECT id, score / 200 AS p0, (100 - score) / 300 AS p1, CASE WHEN is_anomalous THEN 0.25::DOUBLE ELSE 0 END AS p2 FROM score_timeline)""")
def _(v):
    s = F.col("score")
    short = F.array(s / 200, (100 - s) / 300)
    full = F.array(s / 200, (100 - s) / 300, F.lit(0.25))
    return v.score_timeline.select("id", F.round(M.expected_score(F.when(F.col("is_anomalous"), full).otherwise(short)), 9).alias("expected"))


@query("m10_predict_scores")
def _(v):
    rows = order_training(v)
    model = M.train_trust_model(rows).model
    rule = rows.select("wallet", (F.col("wallet_age_days") * 20).alias("score"))
    return M.predict_scores(model, rows.drop("label"), rule).withColumn("probs", F.size("probs"))


@query("m11_predict_trust")
def _(v):
    rows, cols = event_rows(v)
    model = M.train_scam_model(rows, cols).model
    return M.predict_trust(model, rows.select("wallet", *cols), v.wallets)


SQL_VIEWS["lab01"] = "SELECT wallet, (label <> 'good')::INT AS label FROM labels_merged"


def lab01(v):
    return merged(v).select("wallet", (F.col("label") != "good").cast("int").alias("label"))


_G1, _G2 = [-60, -45, -30, -15], [-80, -40, -20, -10]
_METRICS = """tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r, fp / nullif(fp + tn, 0)::DOUBLE AS x, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f"""
_COUNTS = """count(*) FILTER (label = 1 AND pred) AS tp, count(*) FILTER (label = 0 AND pred) AS fp, count(*) FILTER (label = 0 AND NOT pred) AS tn, count(*) FILTER (label = 1 AND NOT pred) AS fn"""


@query("m12_tune_reason_weights", f"""WITH s AS (SELECT l.wallet, l.label, coalesce(sum(w.weight) FILTER (w.weight > 0), 0) AS pos, coalesce(sum(w.weight) FILTER (w.weight < 0 AND code NOT IN ('SCAM_CLUSTER_MEMBER', 'DRAINER_INTERACTION')), 0) AS neg,
      count(*) FILTER (code = 'SCAM_CLUSTER_MEMBER') AS n0, count(*) FILTER (code = 'DRAINER_INTERACTION') AS n1 FROM lab01 l LEFT JOIN day_codes d ON d.wallet = l.wallet LEFT JOIN w_tab w USING (code) GROUP BY 1, 2),
    q AS (SELECT w0, w1, {_COUNTS} FROM (SELECT *, greatest(0, least(100, 50 + least(40, pos) + neg + n0 * w0 + n1 * w1)) < 20 AS pred FROM s, (SELECT unnest({_G1}) AS w0), (SELECT unnest({_G2}) AS w1)) GROUP BY 1, 2),
    m AS (SELECT w0, w1, {_METRICS} FROM q)
    SELECT w0 AS "SCAM_CLUSTER_MEMBER", w1 AS "DRAINER_INTERACTION", coalesce(p, 0) AS "precision", coalesce(r, 0) AS recall, coalesce(x, 0) AS fpr, coalesce(f, 0) AS f1,
      row_number() OVER (ORDER BY coalesce(f, 0) DESC, w0, w1) = 1 AS is_best FROM m""")
def _(v):
    from catalog.reasons import day_codes

    r = day_codes(v).select("wallet", F.col("code").alias("reason_code"))
    return M.tune_reason_weights(r.distinct(), lab01(v), {"SCAM_CLUSTER_MEMBER": _G1, "DRAINER_INTERACTION": _G2})


_GRID = {"d1": [-60, -40, -20], "d2": [-30, -14], "d3": [-10, -4], "volume_scale": [0.5, 1.0], "time_decay_days": [15, 60], "max_depth": [2, 3]}
SQL_VIEWS["six_labels"] = "SELECT wallet, (score < 70)::INT AS label FROM six_scores"


@query("m13_tune_propagation", f"""WITH g AS (SELECT * FROM (SELECT unnest([-60, -40, -20]) AS d1), (SELECT unnest([-30, -14]) AS d2), (SELECT unnest([-10, -4]) AS d3), (SELECT unnest([0.5, 1.0]) AS volume_scale),
      (SELECT unnest([15, 60]) AS time_decay_days), (SELECT unnest([2, 3]) AS max_depth)),
    s AS (SELECT l.wallet, label, k, coalesce(sum(CASE WHEN depth = 1 THEN x END), 0)::DOUBLE AS s1, coalesce(sum(CASE WHEN depth = 2 THEN x END), 0)::DOUBLE AS s2, coalesce(sum(CASE WHEN depth = 3 THEN x END), 0)::DOUBLE AS s3
      FROM six_labels l CROSS JOIN (SELECT unnest([15, 60]) AS k) LEFT JOIN (SELECT *, CAST(least(1.0, log10(amount + 1) / 3) * exp(-(({AS_OF} - last_ts) / 86400::DOUBLE) / kk) AS DECIMAL(28, 9)) AS x FROM scam_reach_six, (SELECT unnest([15, 60]) AS kk)) r
      ON r.node = l.wallet AND r.kk = k GROUP BY 1, 2, 3),
    q AS (SELECT d1, d2, d3, volume_scale, time_decay_days, max_depth, {_COUNTS} FROM (SELECT g.*, label, greatest(0, 50 + volume_scale * (d1 * s1 + d2 * s2 + CASE WHEN max_depth >= 3 THEN d3 * s3 ELSE 0 END)) < 49 AS pred FROM s JOIN g ON g.time_decay_days = k) GROUP BY ALL),
    m AS (SELECT d1, d2, d3, volume_scale, time_decay_days, max_depth, {_METRICS} FROM q),
    z AS (SELECT * REPLACE (coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(x, 0) AS x, coalesce(f, 0) AS f) FROM m)
    SELECT d1, d2, d3, volume_scale::DOUBLE AS volume_scale, time_decay_days, max_depth, p AS "precision", r AS recall, x AS fpr, f AS f1, row_number() OVER (ORDER BY (p >= 0.95 AND r >= 0.7) DESC, CASE WHEN p >= 0.95 AND r >= 0.7 THEN p ELSE f END DESC,
      CASE WHEN p >= 0.95 AND r >= 0.7 THEN r ELSE 0 END DESC, d1, d2, d3, volume_scale, time_decay_days, max_depth) = 1 AS is_best FROM z""")
def _(v):
    t = v.transfers_six_hour
    labels = t.select(F.explode(F.array("sender", "receiver")).alias("wallet")).distinct().join(
        v.latest_scores.select(F.col("wallet").alias("w"), "score"), F.split("wallet", "@")[0] == F.col("w")).select(
        "wallet", (F.col("score") < 70).cast("int").alias("label"))
    return M.tune_propagation(und_six(v), v.scam_six_hour, labels, _GRID, AS_OF, scam_below=49.0)


@query("m14_save_load_model")
def _(v):
    t = M.train_token_model(flagged_tokens(v), v.scam_suppliers)
    folder = f"{shared_dir(v.spark)}/models-{uuid.uuid4().hex}"
    M.save_model(t.model, "token", t.metrics, folder, 1)
    M.save_model(t.model, "token", t.metrics, folder, 2)
    model = M.load_model(v.spark, "token", folder)
    rows = M.token_training_rows(flagged_tokens(v), v.scam_suppliers)
    return model.transform(rows).select("mint", "prediction")
