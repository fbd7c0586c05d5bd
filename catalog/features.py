"""Activity and drainer features over the event and order transfers."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import SQL_VIEWS
from ledgerwise import params as P
from ledgerwise.operators import drainer as D
from ledgerwise.operators import features as O

TEST_CFG = P.AnomalyConfig(burst_per_day=(6.0, 5.0, 2.0), velocity_sol=(300.0, 250.0, 100.0))

_ENDS = """SELECT sender AS wallet, receiver AS counterparty, true AS is_sender, * EXCLUDE (wallet) FROM {t}
    UNION ALL SELECT receiver, sender, false, * EXCLUDE (wallet) FROM {t} WHERE receiver <> sender"""
SQL_VIEWS["ends"] = _ENDS.format(t="transfers")
SQL_VIEWS["ends_large"] = _ENDS.format(t="transfers_large")

_FEATURES = """SELECT wallet, count(*) AS tx_count, count(*) / span_days AS tx_frequency,
    round(CAST(sum(amount_lamports) AS DOUBLE) / count(*) * 100) / 100 AS avg_lamports,
    round(sum(amount_lamports) / 1e9 / count(*) * 1e9) / 1e9 AS avg_sol,
    count(DISTINCT CASE WHEN counterparty <> wallet THEN counterparty END) AS unique_counterparties,
    CAST(sum(amount_lamports) AS DOUBLE) / span_days AS velocity_lamports,
    sum(amount_lamports) / 1e9 / span_days AS velocity_sol,
    CAST(sum(amount_lamports) AS BIGINT) AS volume_lamports, round(sum(amount_lamports) / 1e9 * 1e9) / 1e9 AS volume_sol,
    span_days, span_s
    FROM (SELECT *, span_s / 86400.0 AS span_days FROM (SELECT *, CASE WHEN max(ts) OVER w > min(ts) OVER w
          THEN CAST(max(ts) OVER w - min(ts) OVER w AS DOUBLE) END AS span_s FROM {e}
          WINDOW w AS (PARTITION BY wallet)))
    GROUP BY wallet, span_s, span_days"""
SQL_VIEWS["features"] = _FEATURES.format(e="ends").replace("/ 1e9", "/ CAST(1e9 AS DOUBLE)").replace(
    "* 1e9", "* CAST(1e9 AS DOUBLE)").replace("86400.0", "CAST(86400 AS DOUBLE)")


def _flag_rows(cfg: P.AnomalyConfig) -> str:
    def part(pos, kind, rule, value, limits, cond, msg):
        c, h, m = limits
        lim = f"CASE WHEN {value} >= {c} THEN {c} WHEN {value} >= {h} THEN {h} ELSE {m} END"
        sev = f"CASE WHEN {value} >= {c} THEN 'critical' WHEN {value} >= {h} THEN 'high' ELSE 'medium' END"
        return (f"SELECT wallet, {pos} AS pos, '{kind}' AS type, {sev} AS severity, "
                f"printf({msg}, CAST({lim} AS DOUBLE)) AS message FROM features WHERE {cond} AND {value} >= {m}")

    return " UNION ALL ".join([
        part(1, "burst_transactions", "", "tx_frequency", cfg.burst_per_day, "tx_count >= 2",
             "'Burst activity: %.1f transactions per day (threshold: %.1f)', tx_frequency"),
        part(2, "suspicious_velocity", "", "velocity_sol", cfg.velocity_sol, "true",
             "'Suspicious velocity: %.2f SOL/day (threshold: %.1f SOL/day)', velocity_sol"),
        part(3, "fresh_wallet_high_value", "", "greatest(volume_sol, avg_sol)", cfg.fresh_sol,
             f"tx_count BETWEEN 1 AND {cfg.fresh_max_tx}",
             "'Fresh wallet (%d txs) moving high value: %.2f SOL (threshold: %.1f SOL)', tx_count, "
             "greatest(volume_sol, avg_sol)"),
    ])


SQL_VIEWS["flag_rows"] = _flag_rows(TEST_CFG)
SQL_VIEWS["flag_rows_default"] = _flag_rows(P.AnomalyConfig())
SQL_VIEWS["records"] = """SELECT wallet, signature, ts, slot, program_id, is_sender, counterparty,
    program_id = 'signup' AS approval_like, program_id = 'click' AS has_swap FROM ends"""


def records(v):
    return O.wallet_records(v.transfers).withColumns({
        "approval_like": F.col("program_id") == "signup", "has_swap": F.col("program_id") == "click",
    })


def test_flags(v):
    return O.anomaly_flags(O.wallet_features(v.transfers), TEST_CFG)


_ROUND = """SELECT wallet, tx_count, round(tx_frequency, 6) AS tx_frequency, avg_lamports, avg_sol,
    unique_counterparties, round(velocity_lamports / 1e9, 6) AS velocity_lamports_e9,
    round(velocity_sol, 6) AS velocity_sol, volume_lamports, volume_sol, round(span_days, 9) AS span_days, span_s
    FROM {f}"""


def _shown(df):
    return df.select(
        "wallet", "tx_count", F.round("tx_frequency", 6).alias("tx_frequency"), "avg_lamports", "avg_sol",
        "unique_counterparties", F.round(F.col("velocity_lamports") / 1e9, 6).alias("velocity_lamports_e9"),
        F.round("velocity_sol", 6).alias("velocity_sol"), "volume_lamports", "volume_sol",
        F.round("span_days", 9).alias("span_days"), "span_s",
    )


@query("f01_wallet_features", _ROUND.format(f="features"))
def _(v):
    return _shown(O.wallet_features(v.transfers))


SQL_VIEWS["features_large"] = SQL_VIEWS["features"].replace("FROM ends", "FROM ends_large")


@query("f01_wallet_features_large", _ROUND.format(f="features_large"))
def _(v):
    return _shown(O.wallet_features(v.transfers_large))


@query("f02_tx_frequency", """SELECT wallet, count(*) AS tx_count, count(*) FILTER (is_sender) AS as_sender_count,
    count(*) FILTER (NOT is_sender) AS as_receiver_count FROM (
    SELECT sender AS wallet, true AS is_sender FROM transfers UNION ALL SELECT receiver, false FROM transfers)
    GROUP BY 1""")
def _(v):
    return O.tx_frequency(v.transfers)


def _flat(df):
    return df.select("wallet", F.posexplode("flags").alias("pos", "f")).select(
        "wallet", "f.type", "f.severity", "f.message")


@query("f03_anomaly_flags", "SELECT wallet, type, severity, message FROM flag_rows")
def _(v):
    return _flat(test_flags(v))


@query("f03_anomaly_flags_default", "SELECT wallet, type, severity, message FROM flag_rows_default")
def _(v):
    return _flat(O.anomaly_flags(O.wallet_features(v.transfers)))


@query("f04_anomaly_summary", """SELECT f.wallet, count(r.type) > 0 AS is_anomalous,
    CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 END)
      WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' END AS max_severity
    FROM features f LEFT JOIN flag_rows r ON r.wallet = f.wallet GROUP BY 1""")
def _(v):
    return O.anomaly_summary(test_flags(v))


_SCORE = """SELECT f.wallet, greatest(0.0, 100.0 - coalesce(sum(CASE severity WHEN 'critical' THEN 25.0
    WHEN 'high' THEN 15.0 WHEN 'medium' THEN 8.0 END), 0.0))::DOUBLE AS score
    FROM features f LEFT JOIN {r} r ON r.wallet = f.wallet GROUP BY 1"""


@query("f05_base_trust_score", _SCORE.format(r="flag_rows_default"))
def _(v):
    return O.base_trust_score(O.anomaly_flags(O.wallet_features(v.transfers)))


@query("f05_base_trust_score_strict", _SCORE.format(r="flag_rows"))
def _(v):
    return O.base_trust_score(test_flags(v))


FLOW = """SELECT wallet, count(*) AS total_tx, count(DISTINCT counterparty) AS unique_destinations,
    count(*) FILTER (near > 1) AS rapid_tx_count,
    round(coalesce((max(ts) - min(ts)) / nullif(count(*) - 1, 0), 0) * 100) / 100 AS avg_tx_interval,
    round(100.0 * count(DISTINCT counterparty) / count(*)::DOUBLE * 100) / 100 AS percent_to_new_wallets,
    max(run_len) AS tx_chain_length_estimate
    FROM (SELECT *, count(*) OVER (PARTITION BY wallet, run) AS run_len FROM (
      SELECT *, sum(brk) OVER (PARTITION BY wallet ORDER BY slot, signature) AS run FROM (
        SELECT *, count(*) OVER (PARTITION BY wallet ORDER BY ts RANGE BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS near,
          CASE WHEN slot - lag(slot) OVER (PARTITION BY wallet ORDER BY slot, signature) > 2 THEN 1 ELSE 0 END AS brk
        FROM {rows})))
    GROUP BY wallet"""
SQL_VIEWS["flow"] = FLOW.format(rows="ends")
SQL_VIEWS["flow_newest"] = FLOW.format(rows="(SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, signature DESC) <= 50)")


@query("f06_flow_features", "SELECT * FROM flow")
def _(v):
    return O.flow_features(v.transfers)


@query("f06_flow_features_newest", "SELECT * FROM flow_newest")
def _(v):
    return O.flow_features(v.transfers, n=50)


@query("f07_transfer_destination", """SELECT signature, wallet, supplier AS "to" FROM tx_lines
    QUALIFY row_number() OVER (PARTITION BY signature ORDER BY l_linenumber, l_suppkey, l_partkey, lamports) = 1""")
def _(v):
    return O.transfer_destination(v.tx_raw)


@query("f08_tx_failure_features", """SELECT wallet, count(*) AS total_tx, count(err) AS failed_tx,
    round(count(err)::DOUBLE / count(*) * 1000) / 1000 AS failure_ratio FROM transfers GROUP BY 1""")
def _(v):
    return O.tx_failure_features(v.transfers)


SQL_VIEWS["d_approval"] = """SELECT a.wallet, count(*) FILTER (EXISTS (SELECT 1 FROM records b WHERE b.approval_like
    AND b.wallet = a.wallet AND b.ts <> a.ts AND abs(b.ts - a.ts) <= 30)) AS approval_like_count
    FROM records a WHERE approval_like GROUP BY 1"""
SQL_VIEWS["d_rapid"] = """SELECT wallet, count(*) FILTER (n > 1) AS rapid_outflow_count FROM (SELECT wallet,
    count(*) OVER (PARTITION BY wallet ORDER BY ts RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS n
    FROM records WHERE is_sender) GROUP BY 1"""
SQL_VIEWS["d_victim"] = """SELECT wallet, CAST(count(DISTINCT CASE WHEN NOT is_sender THEN counterparty END) >= 3 AND
    count(DISTINCT CASE WHEN is_sender THEN counterparty END) <= 2 AS INTEGER) AS multi_victim_pattern
    FROM records GROUP BY 1"""
SQL_VIEWS["d_program"] = """SELECT wallet, count(*) FILTER (total >= 2 AND first_rank > total // 2)
    AS new_contract_interaction_count FROM (SELECT wallet, program_id, min(rk) AS first_rank, max(total) AS total FROM (
      SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY slot, signature) AS rk,
      count(*) OVER (PARTITION BY wallet) AS total FROM records) GROUP BY 1, 2) GROUP BY 1"""
SQL_VIEWS["d_swap"] = """SELECT a.wallet, count(*) FILTER (a.has_swap AND EXISTS (SELECT 1 FROM rk b
    WHERE b.wallet = a.wallet AND b.rn BETWEEN a.rn + 1 AND a.rn + 3 AND b.slot - a.slot <= 2 AND b.is_sender))
    AS swap_then_transfer_pattern FROM rk a GROUP BY 1"""
SQL_VIEWS["rk"] = "SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY slot, signature) AS rn FROM records"
SQL_VIEWS["d_top"] = """SELECT wallet, round(100.0 * (max(n) / sum(n)::DOUBLE) * 100) / 100 AS percent_to_same_cluster
    FROM (SELECT wallet, counterparty, count(*) AS n FROM records WHERE is_sender GROUP BY 1, 2) GROUP BY 1"""
SQL_VIEWS["drain"] = """SELECT w.wallet, coalesce(approval_like_count, 0) AS approval_like_count,
    coalesce(rapid_outflow_count, 0) AS rapid_outflow_count, coalesce(multi_victim_pattern, 0) AS multi_victim_pattern,
    coalesce(new_contract_interaction_count, 0) AS new_contract_interaction_count,
    coalesce(swap_then_transfer_pattern, 0) AS swap_then_transfer_pattern,
    coalesce(percent_to_same_cluster, 0) AS percent_to_same_cluster
    FROM wallets w LEFT JOIN d_approval USING (wallet) LEFT JOIN d_rapid USING (wallet)
    LEFT JOIN d_victim USING (wallet) LEFT JOIN d_program USING (wallet) LEFT JOIN d_swap USING (wallet)
    LEFT JOIN d_top USING (wallet)"""

for _name, _view, _fn in [
    ("f09_approval_like_count", "d_approval", D.approval_like_count),
    ("f10_rapid_outflow_count", "d_rapid", D.rapid_outflow_count),
    ("f11_multi_victim_pattern", "d_victim", D.multi_victim_pattern),
    ("f12_new_program_count", "d_program", D.new_program_count),
    ("f13_swap_then_transfer", "d_swap", D.swap_then_transfer),
    ("f14_percent_to_top_destination", "d_top", D.percent_to_top_destination),
]:
    query(_name, f"SELECT * FROM {_view}")(lambda v, fn=_fn: fn(records(v)))


@query("f15_drainer_features", "SELECT * FROM drain")
def _(v):
    return D.drainer_features(records(v), v.wallets)
