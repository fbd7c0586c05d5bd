"""Hand-computed cases: ties, blanks, limits and worked scores."""

from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions import scores as S
from ledgerwise.functions.common import near_in_time, split_lag, split_rank
from ledgerwise.operators import alerts as A
from ledgerwise.operators import analysis, drainer, graph, propagation, reasons, reports, scoring, timeseries
from ledgerwise.operators import features as O
from ledgerwise.sources import tables

DAY = 86_400
SOL = 1_000_000_000


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def transfers(spark, data):
    """(signature, sender, receiver, sol, ts) rows."""
    return spark.createDataFrame(
        [(s, a, a, b, int(x * SOL) if x is not None else None, t, t, "p", "SOL", None) for s, a, b, x, t in data],
        "signature string, wallet string, sender string, receiver string, amount_lamports bigint, ts bigint, slot bigint, "
        "program_id string, token string, err string")


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1, 1, 0) for a, b in pairs], "sender string, receiver string, tx_count bigint, volume bigint, last_ts bigint")


def wallets(spark, names):
    return spark.createDataFrame([(n,) for n in names], "wallet string")


def test_features_blank_self_and_single(spark):
    t = transfers(spark, [("1", "A", "B", 1.0, 0), ("2", "A", "A", 2.0, DAY), ("3", " ", "B", 4.0, None), ("4", None, "C", 8.0, 5),
                          ("5", " A ", "B", 1.0, 2 * DAY)])
    out = {r["wallet"]: r for r in O.wallet_features(t).collect()}
    assert set(out) == {"A", "B", "C"}
    a = out["A"]
    assert (a["tx_count"], a["unique_counterparties"], a["volume_sol"], a["span_days"]) == (3, 1, 4.0, 2.0)
    assert a["tx_frequency"] == 1.5 and a["velocity_sol"] == 2.0
    assert out["C"]["tx_frequency"] is None and out["C"]["unique_counterparties"] == 0
    assert rows(O.tx_frequency(t), "wallet", "tx_count") == [("A", 4), ("B", 3), ("C", 1)]


def test_anomaly_limits(spark):
    def f(freq, vel=0.0, n=50, vol=0.0):
        return ("w", n, freq, vel, vol, vol / n)

    schema = "wallet string, tx_count bigint, tx_frequency double, velocity_sol double, volume_sol double, avg_sol double"
    cases = [(19.9, None), (20.0, "medium"), (49.9, "medium"), (50.0, "high"), (100.0, "critical")]
    for freq, want in cases:
        flags = O.anomaly_flags(spark.createDataFrame([f(freq)], schema)).first()["flags"]
        assert [x["severity"] for x in flags] == ([want] if want else [])
    fresh = O.anomaly_flags(spark.createDataFrame([f(0.0, n=5, vol=10.0)], schema))
    assert [x["type"] for x in fresh.first()["flags"]] == ["fresh_wallet_high_value"]
    assert O.base_trust_score(fresh).first()["score"] == 92.0
    assert not O.anomaly_flags(spark.createDataFrame([f(0.0, n=6, vol=10.0)], schema)).first()["flags"]
    summary = O.anomaly_summary(O.anomaly_flags(spark.createDataFrame([f(100.0, 60.0)], schema))).first()
    assert (summary["is_anomalous"], summary["max_severity"]) == (True, "critical")


def test_time_neighbours_across_bucket_edges(spark):
    df = spark.createDataFrame([("a", 3590), ("a", 3620), ("a", 3651), ("b", 100), ("b", 100), ("c", 7199), ("c", 7260)], "wallet string, ts bigint")
    both = near_in_time(df, "wallet", "ts", 30, 30, 3600, "near")
    assert rows(both, "wallet", "ts", "near") == [("a", 3590, True), ("a", 3620, True), ("a", 3651, False), ("b", 100, True), ("b", 100, True),
                                                  ("c", 7199, False), ("c", 7260, False)]
    strict = near_in_time(df, "wallet", "ts", 30, 30, 3600, "near", strict=True)
    assert ("b", 100, False) in rows(strict, "wallet", "ts", "near")
    after = near_in_time(df, "wallet", "ts", 0, 60, 3600, "near")
    assert rows(after.filter("wallet = 'c'"), "ts", "near") == [(7199, False), (7260, False)]


def test_split_rank_and_lag_equal_plain_windows(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("wallet"), (F.col("id") * 37 % 211).alias("ts"), F.col("id").alias("k"))
    r = split_rank(df, ["wallet"], F.floor(F.col("ts") / 20), [F.col("ts"), F.col("k")])
    got = rows(r, "wallet", "ts", "k", "rank", "total")
    by = {}
    for w, t, k in sorted((str(i % 3), i * 37 % 211, i) for i in range(500)):
        by.setdefault(w, []).append((t, k))
    want = sorted((w, t, k, i + 1, len(v)) for w, v in by.items() for i, (t, k) in enumerate(sorted(v)))
    assert got == want
    lag = split_lag(df, ["wallet"], F.floor(F.col("ts") / 20), ["ts", "k"], "k", "prev")
    want = {(w, k): (sorted(v)[i - 1][1] if i else None) for w, v in by.items() for i, (_, k) in enumerate(sorted(v))}
    assert {(r["wallet"], r["k"]): r["prev"] for r in lag.collect()} == want


def _records(spark, data):
    return spark.createDataFrame(data, "wallet string, signature string, ts bigint, slot bigint, program_id string, is_sender boolean, "
                                       "counterparty string, approval_like boolean, has_swap boolean")


def test_drainer_small_counts(spark):
    one = _records(spark, [("a", "1", 0, 0, "p", True, "x", True, True)])
    assert rows(drainer.new_program_count(one), "new_contract_interaction_count") == [(0,)]
    assert rows(drainer.approval_like_count(one), "approval_like_count") == [(0,)]
    r = _records(spark, [
        ("a", "1", 0, 10, "p", True, "x", False, True), ("a", "2", 1, 12, "q", True, "y", False, False),
        ("a", "3", 2, 15, "p", False, "z", False, True), ("a", "4", 3, 18, "r", True, "x", False, False)])
    assert rows(drainer.swap_then_transfer(r), "swap_then_transfer_pattern") == [(1,)]
    assert rows(drainer.new_program_count(r), "new_contract_interaction_count") == [(1,)]
    assert rows(drainer.percent_to_top_destination(r), "percent_to_same_cluster") == [(66.67,)]
    edge = _records(spark, [("a", "1", 0, 9_999, "p", True, "x", False, True), ("a", "2", 1, 10_001, "q", True, "y", False, False)])
    assert rows(drainer.swap_then_transfer(edge), "swap_then_transfer_pattern") == [(1,)]


def test_components_chain_cycle_hub_and_isolated(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]
    hub = [("hub", f"leaf{i}") for i in range(1000)]
    e = edges(spark, chain + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("solo", "solo")] + hub)
    out = dict(rows(graph.connected_components(e), "wallet", "component"))
    assert {out[f"n{i:03d}"] for i in range(121)} == {"n000"}
    assert {out["c1"], out["c2"], out["c3"]} == {"c1"} and out["solo"] == "solo"
    assert {out[f"leaf{i}"] for i in range(1000)} == {"hub"}


def test_distance_and_hops(spark):
    e = edges(spark, [("s", "a"), ("b", "a"), ("b", "c"), ("x", "y")])
    far = dict(rows(graph.distance_to_sources(e, wallets(spark, ["s", "ghost"])), "wallet", "distance"))
    assert far == {"s": 0, "a": 1, "b": 2, "c": 3, "x": -1, "y": -1}
    cut = dict(rows(graph.distance_to_sources(e, wallets(spark, ["s"]), 2, 999), "wallet", "distance"))
    assert cut["c"] == 999 and cut["b"] == 2
    assert rows(graph.k_hop_neighbors(e, wallets(spark, ["s"]), 2), "wallet", "hop") == [("a", 1), ("b", 2)]


def test_propagation_takes_smallest_predecessor(spark):
    und = spark.createDataFrame([("a", "s", 999.0, 0), ("b", "s", 999.0, 0), ("a", "t", 9.0, 0), ("b", "t", 999.0, 0)],
                                "a string, b string, amount double, last_ts bigint")
    out = dict(rows(propagation.propagate_scam_penalty(und, wallets(spark, ["s"]), 0), "wallet", "penalty"))
    assert abs(out["a"] + 40) < 1e-6 and abs(out["t"] + 20 / 3) < 1e-6


def test_identity_cluster_confidence(spark):
    e = spark.createDataFrame([("a", "b", 2, 1, 0), ("b", "a", 2, 1, 0)], "sender string, receiver string, tx_count bigint, volume bigint, last_ts bigint")
    out = propagation.identity_clusters(e).collect()
    assert {r["wallet"] for r in out} == {"a", "b"} and out[0]["reason_tags"] == ["bidirectional", "burst_timing", "circular"]
    assert out[0]["confidence"] == 0.7


def test_rule_score_worked_values(spark):
    m = spark.createDataFrame([("good", 200, 180, 8, 0), ("new", 5, 2, 0, 0)],
                              "wallet string, tx_count bigint, wallet_age_days bigint, unique_programs bigint, token_accounts bigint")
    risk = spark.createDataFrame([("good", [], "LOW"), ("new", ["new_wallet", "inactive"], "MEDIUM")], "wallet string, flags array<string>, risk_level string")
    det = spark.createDataFrame([(w, 0, 0, "none", 0, False, 1, "LOW") for w in ("good", "new")],
                                "wallet string, scam_interactions bigint, rugpull_interactions bigint, nft_role string, received bigint, is_creator boolean, "
                                "cluster_size bigint, cluster_risk string")
    assert rows(analysis.rule_trust_score(m, risk, det), "wallet", "score") == [("good", 82), ("new", 10)]


def test_feature_caps(spark):
    a = spark.createDataFrame([("w", 5000, 3650, 40, 30, 0, 0, 0, 15, "nft_wallet", 100.0, 0, 0, 0, 15, "HIGH")],
                              "wallet string, tx_count bigint, wallet_age_days bigint, unique_programs bigint, token_accounts bigint, nft_count bigint, scam_interactions bigint, "
                              "rugpull_interactions bigint, cluster_size bigint, wallet_type string, avg_tx_value double, dex_interaction_count bigint, lp_interaction_count bigint, "
                              "unique_counterparties bigint, cluster_size_estimate bigint, cluster_risk string")
    r = analysis.normalized_features(a).first()
    assert (r["tx_count"], r["wallet_age_days"], r["unique_programs"], r["token_accounts"], r["cluster_size"]) == (5.0, 5.0, 2.0, 1.5, 1.5)
    assert (r["nft_count"], r["wallet_type_encoded"], r["avg_tx_value"], r["scam_cluster_flag"]) == (0.6, 3.0, 1.0, 1.0)


def test_bayes_edges(spark):
    r = spark.createDataFrame([("weak", "NEW_WALLET"), ("unknown", "SOMETHING"), ("bad", "DRAINER_FLOW"), ("bad", "DRAINER_FLOW"), ("bad", "SCAM_CLUSTER_MEMBER_LARGE"),
                               ("bad", "DRAINER_INTERACTION")], "wallet string, code string")
    p = spark.createDataFrame([("weak", 0.2), ("unknown", 0.3), ("none", 0.9999)], "wallet string, prior double")
    out = dict(rows(scoring.bayes_posterior(r, p), "wallet", "posterior"))
    assert out["weak"] == 0.2 and abs(out["unknown"] - 0.3) < 1e-9 and abs(out["none"] - 0.999) < 1e-9
    odds = 0.05 / 0.95 * 10 * 10 * 7 * 8
    assert abs(out["bad"] - odds / (1 + odds)) < 1e-9


def test_truncation_and_bands(spark):
    df = spark.createDataFrame([(-30, 100), (-30, 0), (7, 400)], "w int, d bigint")
    got = [r[0] for r in df.select(S.time_weighted_penalty(F.col("w"), F.col("d"))).collect()]
    assert got == [-17, -30, 0]
    b = spark.createDataFrame([(19.5,), (20.0,), (39.99,), (60.0,), (80.0,)], "s double")
    assert [r[0] for r in b.select(S.badge(F.col("s"))["name"]).collect()] == ["SCAM_SUSPECTED", "HIGH_RISK", "HIGH_RISK", "TRUSTED", "EXCELLENT"]


def test_reason_rules_far_wallet_and_strict(spark):
    j = spark.createDataFrame([("w", 0.0, 5.0, 400.0, 10.0, 5.0)], "wallet string, is_scam_cluster_member double, distance_to_scam double, wallet_age_days double, total_tx double, unique_destinations double")
    assert reasons.feature_reason_codes(j).first()["codes"] == ["AGE_1Y", "NO_SCAM_HISTORY", "LOW_RISK_CLUSTER", "FAR_FROM_SCAM_CLUSTER", "LONG_HISTORY"]
    z = j.withColumn("distance_to_scam", F.lit(0.0))
    assert "FAR_FROM_SCAM_CLUSTER" not in reasons.feature_reason_codes(z).first()["codes"]
    assert "FAR_FROM_SCAM_CLUSTER" in reasons.feature_reason_codes(z, strict_reference=True).first()["codes"]


def test_no_risk_handling(spark):
    r = spark.createDataFrame([("a", "NO_RISK_DETECTED", 0, None, None, 0), ("a", "NEW_WALLET", -5, 0.5, "t", 0), ("a", "NEW_WALLET", -60, 0.7, "u", 0), ("b", "NO_RISK_DETECTED", 0, None, None, 0)],
                              "wallet string, reason_code string, weight int, confidence double, tx_hash string, created_at bigint")
    s = spark.createDataFrame([("a", 70.0), ("b", 55.0)], "wallet string, score double")
    unique, out = reasons.dedupe_reasons(r, s)
    assert rows(unique, "wallet", "reason_code", "weight") == [("a", "NEW_WALLET", -50), ("b", "NO_RISK_DETECTED", 0)]
    assert rows(out, "wallet", "score", "risk_level") == [("a", 20.0, "2"), ("b", 55.0, "1")]
    d = reasons.default_reasons(r, s, DAY)
    assert rows(d, "wallet", "code") == [("a", "NEW_WALLET"), ("a", "NEW_WALLET"), ("b", "CLEAN_HISTORY"), ("b", "NO_RISK_DETECTED")]


def test_sources(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text("address,label\n AAA ,x\n,y\nAAA,z\nBBB,\n")
    assert rows(tables.read_wallet_csv(spark, str(path)), "wallet") == [("AAA",), ("BBB",)]
    df = spark.createDataFrame([('["a", "b"]',), ("['c']",), ("d; e,f,",), ("[]",)], "x string")
    assert [r[0] for r in df.select(tables.parse_list_column(F.col("x"))).collect()] == [["a", "b"], ["c"], ["d", "e", "f"], []]
    out = str(tmp_path / "out")
    tables.write_table(df, out, "csv")
    assert spark.read.csv(out, header=True).count() == 4
    fresh, n = tables.incremental_append(wallets(spark, ["a"]), wallets(spark, ["a", "b", "b"]), ["wallet"])
    assert n.first()[0] == 1


def test_flow_paths_limits_without_all_pairs(spark):
    members = spark.createDataFrame([(1, f"m{i:03d}") for i in range(60)], "cluster_id bigint, wallet string")
    s = spark.createDataFrame([("m000", 10.0)], "wallet string, score double")
    out = reports.flow_paths(transfers(spark, [("1", "m059", "zzz", 1.0, 0)]), members, s, n=5)
    assert rows(out.filter("source = 'm059'"), "target", "risk") == [("m000", "HIGH")] + [(f"m{i:03d}", None) for i in range(1, 5)]
    assert rows(out.filter("source = 'm002'"), "target") == [("m000",), ("m001",), ("m003",), ("m004",), ("m005",)]


def test_alert_cooldown_edges(spark):
    s = spark.createDataFrame([("a", 49.9), ("b", 50.0)], "wallet string, score double")
    flags = spark.createDataFrame([("a", [])], "wallet string, flags array<struct<type: string, severity: string, message: string>>")
    none = spark.createDataFrame([], "wallet string, severity string, reason string, created_at bigint")
    first = A.alerts(s, flags, none, 10_000)
    assert rows(first, "wallet", "reason") == [("a", "Trust score below threshold: 49.9 < 50.0")]
    assert A.alerts(s, flags, first, 13_600).count() == 0
    assert A.alerts(s, flags, first, 13_601).count() == 1


def test_baseline_needs_two_periods(spark):
    h = spark.createDataFrame([("a", 7, 1, 10, 1, 0, 50.0, 0), ("b", 7, 1, 10, 1, 0, 50.0, 0), ("b", 7, 2, 21, 2, 1, None, 0)],
                              "wallet string, window_days int, period_end bigint, volume bigint, tx_count bigint, anomaly_count bigint, avg_score double, alert_count bigint")
    assert rows(timeseries.baseline(h), "wallet", "volume", "tx_count", "avg_score") == [("b", 15, 1, 50.0)]


def test_params_agree_with_bands():
    assert sorted(P.SEVERITY_RANK, key=P.SEVERITY_RANK.get) == ["low", "medium", "high", "critical"]
