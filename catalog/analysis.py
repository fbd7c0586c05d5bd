"""Wallet analysis over order transactions, evidence over event transfers."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import AS_OF, AS_OF_ORDERS, DAY, SQL_VIEWS
from ledgerwise.operators import analysis as A
from ledgerwise.operators import evidence as E
from ledgerwise.operators.graph import neighborhood_cluster
from ledgerwise.plans.wallet_analysis import wallet_analysis

D = "CAST(1e9 AS DOUBLE)"
SQL_VIEWS["tx_rank"] = """SELECT signature, wallet, block_time, row_number() OVER (PARTITION BY wallet
    ORDER BY block_time DESC, signature DESC) AS rn FROM tx_heads"""
SQL_VIEWS["tx_prog"] = """SELECT DISTINCT signature, wallet, p FROM (
    SELECT signature, wallet, program_id AS p FROM tx_lines UNION ALL
    SELECT signature, wallet, 'inner-' || l_returnflag FROM tx_lines QUALIFY row_number() OVER (
      PARTITION BY signature ORDER BY l_linenumber, l_suppkey, l_partkey, lamports) = 1)"""
SQL_VIEWS["metrics"] = f"""SELECT b.wallet, tx_count, wallet_age_days, coalesce(u, 0) AS unique_programs,
    coalesce(t, 0) AS token_accounts FROM (
      SELECT wallet, count(*) AS tx_count, ({AS_OF_ORDERS} - min(block_time)) // {DAY} AS wallet_age_days
      FROM tx_rank GROUP BY 1) b
    LEFT JOIN (SELECT r.wallet, count(DISTINCT p) AS u FROM tx_rank r JOIN tx_prog USING (signature)
      GROUP BY 1) p ON p.wallet = b.wallet
    LEFT JOIN (SELECT wallet, count(*) AS t FROM token_accounts GROUP BY 1) h ON h.wallet = b.wallet"""
SQL_VIEWS["avg_val"] = f"""SELECT wallet, sum(total + 10000) / count(*)::DOUBLE / {D} AS sol FROM (
    SELECT l.signature, l.wallet, sum(lamports) AS total FROM tx_lines l JOIN tx_rank r ON r.signature = l.signature
    GROUP BY 1, 2) GROUP BY 1"""
SQL_VIEWS["dexlp"] = """SELECT r.wallet, count(DISTINCT CASE WHEN p = 'RF' THEN signature END) AS dex,
    count(DISTINCT CASE WHEN p IN ('AF', 'inner-N') THEN signature END) AS lp
    FROM tx_rank r JOIN tx_prog USING (signature) GROUP BY 1"""
SQL_VIEWS["nfts"] = """SELECT wallet, count(*) FILTER (decimals = 0 AND amount = 1) AS n FROM token_accounts GROUP BY 1"""
SQL_VIEWS["cl_est"] = """SELECT r.wallet, greatest(1, count(DISTINCT supplier)) AS n FROM tx_rank r
    JOIN tx_lines USING (signature) GROUP BY 1"""
SQL_VIEWS["wtype"] = """SELECT wallet, CASE WHEN token_accounts > 20 THEN 'nft_wallet'
    WHEN tx_count < 10 AND wallet_age_days > 365 THEN 'cold_wallet'
    WHEN tx_count > 500 AND unique_programs <= 5 THEN 'service_wallet'
    WHEN tx_count > 200 AND unique_programs > 10 THEN 'trader_wallet' WHEN tx_count < 3 THEN 'inactive_wallet'
    WHEN tx_count < 5 AND wallet_age_days < 90 THEN 'inactive_wallet' ELSE 'unknown' END AS wallet_type FROM metrics"""
_F = "CASE WHEN {c} THEN '{n}' END"
SQL_VIEWS["wrisk"] = """SELECT wallet, flags, len(flags) AS n, CASE WHEN len(flags) = 0 THEN 'LOW'
    WHEN len(flags) <= 2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM (
    SELECT m.wallet, list_filter([
      CASE WHEN wallet_age_days < 3 THEN 'new_wallet' END,
      CASE WHEN wallet_type NOT IN ('cold_wallet', 'service_wallet') AND tx_count < 5 THEN 'low_activity' END,
      CASE WHEN wallet_type NOT IN ('cold_wallet', 'service_wallet') AND unique_programs = 0 THEN 'inactive' END,
      CASE WHEN token_accounts > 100 THEN 'suspicious_distribution' END], lambda x: x IS NOT NULL) AS flags
    FROM metrics m JOIN wtype USING (wallet))"""
SQL_VIEWS["bad_prog"] = """SELECT DISTINCT l_returnflag || l_linestatus AS p FROM lineitem WHERE l_linestatus = 'O'
    AND l_tax >= (SELECT max(l_tax) FROM lineitem)"""
SQL_VIEWS["scam_prog"] = """SELECT w.wallet, coalesce(n, 0) AS interactions, coalesce(ps, '') AS programs
    FROM (SELECT DISTINCT wallet FROM tx_heads) w LEFT JOIN (
      SELECT r.wallet, count(DISTINCT signature) AS n, string_agg(DISTINCT p, ',' ORDER BY p) AS ps FROM tx_rank r
      JOIN tx_prog USING (signature) WHERE p IN (FROM bad_prog) GROUP BY 1) x USING (wallet)"""
SQL_VIEWS["bad_mint"] = "SELECT mint FROM tokens WHERE mint_authority IS NOT NULL AND freeze_authority IS NOT NULL"
SQL_VIEWS["rug"] = """SELECT wallet, count(*) AS interactions, string_agg(mint, ',' ORDER BY mint) AS tokens_held
    FROM token_accounts WHERE mint IN (FROM bad_mint) GROUP BY 1"""
SQL_VIEWS["nft_held"] = """SELECT a.wallet, a.mint, mint_authority, creator_wallets FROM (
      SELECT * FROM token_accounts WHERE decimals = 0 AND amount = 1) a
    JOIN tokens t USING (mint) WHERE collection LIKE 'P%'"""
SQL_VIEWS["nft_role"] = """SELECT *, CASE WHEN minted > 0 OR is_creator OR distributed >= 10 THEN 'scammer'
      WHEN received > 0 AND distributed > 0 THEN 'participant' WHEN received > 0 THEN 'victim' ELSE 'none' END AS role
    FROM (SELECT w.wallet, coalesce(received, 0) AS received, coalesce(minted, 0) AS minted,
        coalesce(distributed, 0) AS distributed, coalesce(is_creator, false) AS is_creator
      FROM (SELECT DISTINCT wallet FROM token_accounts) w
      LEFT JOIN (SELECT wallet, count(*) AS received, count(*) FILTER (mint_authority = wallet) AS minted,
        bool_or(list_contains(creator_wallets, wallet)) AS is_creator FROM nft_held GROUP BY 1) USING (wallet)
      LEFT JOIN (SELECT l.wallet, count(*) AS distributed FROM tx_lines l JOIN tx_rank r ON r.signature = l.signature
        JOIN nft_held h ON h.wallet = l.wallet AND h.mint = l.mint WHERE l_returnflag = 'R' GROUP BY 1)
      USING (wallet))"""
SQL_VIEWS["ncluster"] = """SELECT wallet, count(*) AS cluster_size, CASE WHEN count(b) > 0 THEN 'HIGH' ELSE 'LOW' END
    AS cluster_risk FROM (SELECT DISTINCT k.wallet, k.node, s.wallet AS b FROM tx_keys k
      LEFT JOIN scam_suppliers s ON s.wallet = k.node) GROUP BY 1"""
SQL_VIEWS["detect"] = """SELECT m.wallet, coalesce(sp.interactions, 0) AS scam_i, coalesce(rg.interactions, 0) AS rug_i,
    coalesce(role, 'none') AS nft_role_name, coalesce(received, 0) AS received, coalesce(is_creator, false) AS is_creator,
    coalesce(cluster_size, 1) AS cluster_size, coalesce(cluster_risk, 'LOW') AS cluster_risk
    FROM metrics m LEFT JOIN scam_prog sp USING (wallet) LEFT JOIN rug rg USING (wallet)
    LEFT JOIN nft_role USING (wallet) LEFT JOIN ncluster USING (wallet)"""
SQL_VIEWS["rule_score"] = """SELECT wallet, CAST(greatest(0, least(100, 40 + least(tx_count // 10, 30)
      + least(wallet_age_days // 30, 20) + least(unique_programs * 2, 20) - 15 * n - CASE WHEN scam_i > 0 THEN 40
      WHEN nft_role_name = 'scammer' THEN 35 WHEN cluster_risk = 'HIGH' THEN 50 ELSE 0 END
      - CASE WHEN rug_i > 0 THEN 30 ELSE 0 END)) AS INTEGER) AS score,
    CASE WHEN scam_i > 0 OR nft_role_name = 'scammer' OR cluster_risk = 'HIGH' THEN 'HIGH' ELSE risk_level END AS risk_label
    FROM metrics JOIN wrisk USING (wallet) JOIN detect USING (wallet)"""
SQL_VIEWS["rule_codes"] = """SELECT wallet, array_to_string(list_filter([
      CASE WHEN list_contains(flags, 'new_wallet') THEN 'NEW_WALLET' END,
      CASE WHEN list_contains(flags, 'low_activity') OR list_contains(flags, 'inactive') THEN 'LOW_ACTIVITY' END,
      CASE WHEN scam_i > 0 THEN 'KNOWN_SCAM_PROGRAM' END, CASE WHEN scam_i > 0 OR rug_i > 0 THEN 'RUG_PULL_TOKEN' END,
      CASE WHEN cluster_risk = 'HIGH' THEN 'SCAM_CLUSTER' END, CASE WHEN nft_role_name = 'scammer' THEN 'SCAM_NFT_CREATOR' END,
      CASE WHEN received > 0 THEN 'SCAM_NFT_RECEIVED' END,
      CASE WHEN is_creator AND nft_role_name <> 'scammer' THEN 'SCAM_NFT_CREATOR' END,
      CASE WHEN wallet_type = 'service_wallet' THEN 'SERVICE_WALLET' END,
      CASE WHEN wallet_type = 'cold_wallet' THEN 'COLD_WALLET' END], lambda x: x IS NOT NULL), ',') AS reason_codes
    FROM wrisk JOIN detect USING (wallet) JOIN wtype USING (wallet)"""
SQL_VIEWS["basic_ml"] = f"""SELECT b.wallet, total_tx, account_age_days, coalesce(c, 0) AS unique_counterparties FROM (
    SELECT wallet, count(*) AS total_tx, CAST(({AS_OF_ORDERS} - min(block_time)) // {DAY} AS INTEGER) AS account_age_days
    FROM tx_rank GROUP BY 1) b LEFT JOIN (
    SELECT r.wallet, count(DISTINCT node) AS c FROM tx_rank r JOIN (SELECT signature, supplier AS node FROM tx_lines
      UNION ALL SELECT signature, 'transfer-program' FROM tx_heads) USING (signature) GROUP BY 1) k USING (wallet)"""


def metrics(v):
    return A.wallet_metrics(v.tx_raw, v.token_accounts, AS_OF_ORDERS)


def _parts(v):
    m = metrics(v)
    t = A.classify_wallet(m)
    r = A.risk_flags(m, t)
    tx = v.tx_raw
    d = A.detector_table(
        m, A.scam_program_interactions(tx, v.scam_programs), A.rugpull_holdings(v.token_accounts, v.scam_tokens),
        A.nft_scam_role(v.token_accounts, v.tokens, tx, v.scam_collections),
        neighborhood_cluster(tx, v.scam_suppliers, ["transfer-program"], min_len=1))
    return m, t, r, d


@query("f16_wallet_metrics", "SELECT * FROM metrics")
def _(v):
    return metrics(v)


@query("f16_metrics_newest", """SELECT wallet, count(*) AS tx_count FROM tx_rank WHERE rn <= 5 GROUP BY 1""")
def _(v):
    return A.wallet_metrics(v.tx_raw, v.token_accounts, AS_OF_ORDERS, n=5, n_programs=5).select("wallet", "tx_count")


@query("f17_avg_tx_value", "SELECT wallet, round(sol, 6) AS sol FROM avg_val")
def _(v):
    return A.avg_tx_value(v.tx_raw).withColumn("sol", F.round("sol", 6))


@query("f18_dex_lp_interactions", "SELECT * FROM dexlp")
def _(v):
    return A.dex_lp_interactions(v.tx_raw, ["RF"], ["AF", "inner-N"])


@query("f19_nft_count", "SELECT * FROM nfts")
def _(v):
    return A.nft_count(v.token_accounts)


@query("f20_cluster_size_estimate", "SELECT * FROM cl_est")
def _(v):
    return A.cluster_size_estimate(v.tx_raw, ["transfer-program"], min_len=1)


@query("f21_classify_wallet", "SELECT * FROM wtype")
def _(v):
    return A.classify_wallet(metrics(v))


@query("f22_risk_flags", "SELECT wallet, array_to_string(flags, ',') AS flags, risk_level FROM wrisk")
def _(v):
    m = metrics(v)
    return A.risk_flags(m, A.classify_wallet(m)).withColumn("flags", F.array_join("flags", ","))


@query("f23_scam_program_interactions", "SELECT * FROM scam_prog")
def _(v):
    return A.scam_program_interactions(v.tx_raw, v.scam_programs).withColumn("programs", F.array_join("programs", ","))


@query("f24_rugpull_holdings", "SELECT * FROM rug")
def _(v):
    return A.rugpull_holdings(v.token_accounts, v.scam_tokens).select(
        "wallet", "interactions", F.array_join("tokens", ",").alias("tokens_held"))


@query("f25_nft_scam_role", "SELECT * FROM nft_role")
def _(v):
    return A.nft_scam_role(v.token_accounts, v.tokens, v.tx_raw, v.scam_collections)


@query("f26_rule_trust_score", "SELECT * FROM rule_score")
def _(v):
    m, t, r, d = _parts(v)
    return A.rule_trust_score(m, r, d)


@query("f27_rule_reason_codes", "SELECT * FROM rule_codes")
def _(v):
    m, t, r, d = _parts(v)
    return A.rule_reason_codes(r, d, t).withColumn("reason_codes", F.array_join("reason_codes", ","))


def analysis(v):
    return wallet_analysis(v.tx_raw, v.token_accounts, v.tokens, v.lists, AS_OF_ORDERS, min_key_len=1)


@query("f28_wallet_analysis", """SELECT m.*, t.wallet_type, risk_level, s.score, s.risk_label, c.reason_codes,
    d.cluster_size, round(a.sol, 6) AS avg_tx_value FROM metrics m JOIN wtype t USING (wallet) JOIN wrisk USING (wallet)
    JOIN rule_score s USING (wallet) JOIN rule_codes c USING (wallet) JOIN detect d USING (wallet)
    JOIN avg_val a USING (wallet)""")
def _(v):
    return analysis(v).select(
        "wallet", "tx_count", "wallet_age_days", "unique_programs", "token_accounts", "wallet_type", "risk_level", "score",
        "risk_label", F.array_join("reason_codes", ",").alias("reason_codes"), "cluster_size",
        F.round("avg_tx_value", 6).alias("avg_tx_value"))


SQL_VIEWS["norm_f"] = """SELECT wallet, least(wallet_age_days / 365.0, 5)::DOUBLE AS wallet_age_days,
    least(tx_count / 1000.0, 5)::DOUBLE AS tx_count, least(unique_programs / 20.0, 5)::DOUBLE AS unique_programs,
    least(token_accounts / 20.0, 5)::DOUBLE AS token_accounts,
    least((CASE WHEN coalesce(nfts.n, 0) = 0 THEN token_accounts ELSE nfts.n END) / 50.0, 1)::DOUBLE AS nft_count,
    least(scam_i / 10.0, 5)::DOUBLE AS scam_interactions, least(rug_i / 10.0, 5)::DOUBLE AS rugpull_interactions,
    least(cluster_size / 10.0, 5)::DOUBLE AS cluster_size,
    CASE wallet_type WHEN 'cold_wallet' THEN 0 WHEN 'service_wallet' THEN 1 WHEN 'trader_wallet' THEN 2
      WHEN 'nft_wallet' THEN 3 WHEN 'inactive_wallet' THEN 4 ELSE 5 END::DOUBLE AS wallet_type_encoded,
    least(sol / 10, 1)::DOUBLE AS avg_tx_value, least(dex / 100.0, 1)::DOUBLE AS dex_interaction_count,
    least(lp / 20.0, 1)::DOUBLE AS lp_interaction_count, least(unique_counterparties / 100.0, 5)::DOUBLE AS unique_counterparties,
    least(cl_est.n / 50.0, 1)::DOUBLE AS cluster_size_estimate, (cluster_risk = 'HIGH')::INT::DOUBLE AS scam_cluster_flag
    FROM metrics JOIN wtype USING (wallet) JOIN detect USING (wallet) JOIN avg_val USING (wallet)
    JOIN dexlp USING (wallet) JOIN cl_est USING (wallet) JOIN basic_ml USING (wallet) LEFT JOIN nfts USING (wallet)"""


@query("f29_normalized_features", """SELECT wallet, round(wallet_age_days, 6) AS wallet_age_days,
    tx_count, unique_programs, token_accounts, nft_count, scam_interactions, rugpull_interactions, cluster_size,
    wallet_type_encoded, avg_tx_value, dex_interaction_count, lp_interaction_count, unique_counterparties,
    cluster_size_estimate, scam_cluster_flag FROM norm_f""")
def _(v):
    return A.normalized_features(analysis(v)).withColumn("wallet_age_days", F.round("wallet_age_days", 6))


@query("f30_basic_ml_features", "SELECT * FROM basic_ml")
def _(v):
    return A.basic_ml_features(v.tx_raw, AS_OF_ORDERS)


SQL_VIEWS["tok_f"] = """SELECT * REPLACE (array_to_string(creator_wallets, ';') AS creator_wallets),
    mint_authority IS NOT NULL OR freeze_authority IS NOT NULL OR metadata_missing AS scam_flag FROM tokens"""


@query("f31_token_features", "SELECT * FROM tok_f")
def _(v):
    return A.token_features(v.tokens)


@query("f32_derive_scam_wallets", """SELECT DISTINCT c AS wallet, 'scam' AS label, 'token_scan' AS source FROM (
    SELECT unnest(string_split(creator_wallets, ';')) AS c FROM tok_f WHERE scam_flag)
    WHERE c NOT IN (SELECT wallet FROM scam_suppliers)""")
def _(v):
    t = A.token_features(v.tokens).withColumn("creator_wallets", F.split("creator_wallets", ";"))
    return A.derive_scam_wallets(t, v.scam_suppliers)


@query("f33_wallet_profile", f"""SELECT wallet, least(min(ts), min(ts) FILTER (ts >= {AS_OF - 20 * DAY}) - 7) AS first_seen_at,
    greatest(max(ts), max(ts) FILTER (ts <= {AS_OF - 20 * DAY})) AS last_seen_at FROM transfers GROUP BY 1""")
def _(v):
    t = v.transfers
    late = t.filter(F.col("ts") >= AS_OF - 20 * DAY).groupBy("wallet").agg(
        (F.min("ts") - 7).alias("first_tx_ts"), F.max("ts").alias("last_tx_ts"))
    early = t.filter(F.col("ts") <= AS_OF - 20 * DAY).groupBy("wallet").agg(
        F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
    return E.wallet_profile(t, late, early)


@query("f34_wallet_meta", f"""SELECT wallet, min(ts) AS first_tx_ts, max(ts) AS last_tx_ts,
    ({AS_OF} - min(ts)) // {DAY} AS wallet_age_days,
    coalesce(({AS_OF} - max(CASE WHEN counterparty IN (FROM scam_wallets) THEN ts END)) // {DAY}, 9999) AS last_scam_days
    FROM ends e GROUP BY 1 HAVING max(ts) IS DISTINCT FROM (SELECT max(ts) FROM transfers t WHERE t.sender = e.wallet)""")
def _(v):
    ends = E.both_ends(v.transfers, "ts")
    scam_tx = ends.join(v.scam_wallets.withColumnRenamed("wallet", "counterparty"), "counterparty", "left_semi")
    previous = v.transfers.groupBy("wallet").agg(F.max("ts").alias("last_tx_ts"))
    return E.wallet_meta(v.transfers, previous, AS_OF, scam_tx)


SQL_VIEWS["ev_ends"] = """SELECT sender AS wallet, receiver AS counterparty, true AS is_sender, signature, ts, amount_lamports
    FROM transfers_six_hour UNION ALL SELECT receiver, sender, false, signature, ts, amount_lamports
    FROM transfers_six_hour WHERE sender <> receiver"""
SQL_VIEWS["ev_recent"] = """SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, signature DESC) AS rn,
    count(*) OVER (PARTITION BY wallet) AS n FROM ev_ends"""
SQL_VIEWS["evid"] = f"""SELECT wallet, 'LOW_ACTIVITY' AS reason_code, signature AS tx_signature, NULL::VARCHAR AS counterparty,
      NULL::BIGINT AS amount, ts AS "timestamp" FROM ev_recent WHERE n < 5 AND rn = n
    UNION ALL SELECT wallet, 'NEW_WALLET', arg_min(signature, rn), NULL, NULL, min(ts) FROM ev_recent GROUP BY 1
      HAVING {AS_OF} - min(ts) < {3 * DAY}
    UNION ALL SELECT wallet, 'DRAINER_INTERACTION', signature, counterparty, amount_lamports, ts FROM ev_recent
      WHERE counterparty <> wallet AND counterparty IN (FROM scam_six_hour)
    UNION ALL SELECT wallet, 'HIGH_VALUE_OUTFLOW', signature, counterparty, amount_lamports, ts FROM ev_recent
      WHERE counterparty <> wallet AND is_sender AND amount_lamports >= 100000000000"""


@query("f35_evidence_scan", "SELECT * FROM evid")
def _(v):
    return E.evidence_scan(v.transfers_six_hour, v.scam_six_hour, AS_OF)


@query("f35_high_value_newest", """SELECT wallet, signature AS tx_signature, counterparty, amount_lamports AS amount FROM (
    SELECT * FROM ev_recent WHERE rn <= 10) WHERE counterparty <> wallet AND is_sender AND amount_lamports >= 100000000000""")
def _(v):
    rows = E.evidence_scan(v.transfers_six_hour, v.scam_six_hour, AS_OF, n=10)
    return rows.filter("reason_code = 'HIGH_VALUE_OUTFLOW'").select("wallet", "tx_signature", "counterparty", "amount")


@query("f36_tx_reason_detect", """WITH t AS (SELECT signature, wallet, block_time, any_value(o_orderstatus) = 'F' AS mint,
      any_value(o_orderpriority) LIKE '1%' AS rug, bool_or(lamports >= 40000000000000) AS big, bool_or(program_id = 'RO') AS shady,
      bool_or(supplier IN (FROM scam_suppliers)) AS bad FROM tx_lines
      WHERE signature NOT IN (SELECT signature FROM tx_heads WHERE o_orderstatus = 'P') GROUP BY 1, 2, 3)
    SELECT wallet, 'RUG_PULL_DEPLOYER' AS reason_code, signature AS tx_hash, block_time AS created_at FROM t WHERE rug AND mint
    UNION ALL SELECT wallet, 'DRAINER_TX', signature, block_time FROM t WHERE big OR shady OR bad
    UNION ALL SELECT wallet, 'SCAM_TOKEN_MINT', signature, block_time FROM t WHERE mint""")
def _(v):
    known = v.tx_raw.filter("err IS NOT NULL").select(F.col("signature").alias("tx_hash"))
    return A.tx_reason_detect(v.tx_raw, v.scam_suppliers, ["RO"], known, min_sol=40_000)


SQL_VIEWS["active_w"] = f"""SELECT rpad(wallet, 32, 'A') AS wallet, count(*) AS tx_count, min(ts) AS first_seen, max(ts) AS last_seen
    FROM ends WHERE ts >= {AS_OF - 30 * DAY} GROUP BY 1 HAVING count(*) >= 20 AND ({AS_OF} - min(ts)) // {DAY} >= 7
    AND regexp_matches(rpad(wallet, 32, 'A'), '^[1-9A-HJ-NP-Za-km-z]{{32,44}}$')"""


def _active(v, limit=None):
    t = v.transfers.withColumns({"sender": F.rpad("sender", 32, "A"), "receiver": F.rpad("receiver", 32, "A")})
    return E.active_wallets(t, AS_OF, limit=limit)


@query("f37_active_wallets", "SELECT * FROM active_w")
def _(v):
    return _active(v)


@query("f37_active_wallets_top", "SELECT * FROM active_w ORDER BY tx_count DESC, wallet LIMIT 50")
def _(v):
    return _active(v, 50)


SQL_VIEWS["tok_vec"] = """SELECT wallet, max(mint_authority IS NOT NULL)::INT::DOUBLE AS mint_authority,
    max(freeze_authority IS NOT NULL)::INT::DOUBLE AS freeze_authority, max(metadata_missing)::INT::DOUBLE AS metadata_missing,
    sum(t.decimals)::DOUBLE / count(*) AS decimals, sum(supply)::DOUBLE / count(*) AS supply
    FROM token_accounts a JOIN tokens t USING (mint) GROUP BY 1"""


@query("f38_token_vector", """SELECT wallet, mint_authority, freeze_authority, metadata_missing, round(decimals, 6) AS decimals,
    round(supply, 3) AS supply FROM tok_vec""")
def _(v):
    return A.token_vector(v.token_accounts, v.tokens).withColumns(
        {"decimals": F.round("decimals", 6), "supply": F.round("supply", 3)})
