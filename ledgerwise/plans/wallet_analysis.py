"""On-demand analysis of all wallets: metrics, type, flags, detectors, rule score and blend."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions.common import assemble
from ledgerwise.functions.storage import cut_lineage
from ledgerwise.operators import analysis as A
from ledgerwise.operators.graph import neighborhood_cluster


@dataclass
class Blacklists:
    scam_wallets: DataFrame
    scam_programs: DataFrame
    scam_tokens: DataFrame
    scam_collections: DataFrame
    dex: list[str] = field(default_factory=list)
    lp: list[str] = field(default_factory=list)
    known_programs: list[str] = field(default_factory=list)


def wallet_analysis(tx_raw: DataFrame, token_accounts: DataFrame, tokens: DataFrame, lists: Blacklists, as_of: int,
                    ml_scores: DataFrame | None = None, blend: float = 0.3, min_key_len: int = 32,
                    newest: int | None = None) -> DataFrame:
    """One row per wallet over all transactions, or over the ``newest`` ones of each wallet, ranked and stored once."""
    tx = tx_raw if newest is None else cut_lineage(A.ranked_tx(tx_raw, newest))
    metrics = A.wallet_metrics(tx, token_accounts, as_of)
    detectors = A.detector_parts(
        A.scam_program_interactions(tx, lists.scam_programs), A.rugpull_holdings(token_accounts, lists.scam_tokens),
        A.nft_scam_role(token_accounts, tokens, tx, lists.scam_collections),
        neighborhood_cluster(tx, lists.scam_wallets, lists.known_programs, min_len=min_key_len),
    )
    rows = assemble(
        metrics, *detectors,
        A.avg_tx_value(tx).withColumnRenamed("sol", "avg_tx_value"),
        A.dex_lp_interactions(tx, lists.dex, lists.lp).withColumnsRenamed(
            {"dex": "dex_interaction_count", "lp": "lp_interaction_count"}),
        A.cluster_size_estimate(tx, lists.known_programs, min_len=min_key_len).withColumnRenamed(
            "n", "cluster_size_estimate"),
        A.basic_ml_features(tx, as_of).select("wallet", "unique_counterparties"),
        A.nft_count(token_accounts).withColumnRenamed("n", "nft_count"),
    ).fillna({**A.NO_FINDINGS, "nft_count": 0})
    typed = A.with_risk_flags(rows.withColumn("wallet_type", A.wallet_type_of()))
    out = A.with_rule_score(typed).withColumn("reason_codes", A.rule_codes_of()).withColumnRenamed(
        "score", "score_rule")
    if ml_scores is None:
        return out.withColumn("score", F.col("score_rule"))
    blended = F.round((1 - blend) * F.col("score_rule") + blend * F.col("ml_score")).cast("int")
    return out.join(ml_scores.select("wallet", "ml_score"), "wallet", "left").withColumn(
        "score", F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), blended)), F.col("score_rule")))
