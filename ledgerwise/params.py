"""Fixed values of the scoring model: weights, thresholds, texts and code lists.

Results must agree with these values exactly, so they are stated plainly here.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: reason code weights -------------------------------------------------
REASON_WEIGHTS = {
    "MEGA_DRAINER": -95,
    "RUG_PULL_DEPLOYER": -80,
    "DRAINER_FLOW": -60,
    "SCAM_CLUSTER_MEMBER_SMALL": -20,
    "SCAM_CLUSTER_MEMBER_LARGE": -40,
    "BLACKLISTED_CREATOR": -45,
    "DRAINER_FLOW_DETECTED": -35,
    "SCAM_CLUSTER_MEMBER": -30,
    "HIGH_RISK_TOKEN_INTERACTION": -40,
    "SUSPICIOUS_TOKEN_MINT": -30,
    "DRAINER_INTERACTION": -20,
    "HIGH_VALUE_OUTFLOW": -10,
    "NEW_WALLET": -5,
    "LOW_ACTIVITY": -3,
    "VICTIM_OF_SCAM": 0,
    "CLEAN_HISTORY": 10,
    "NO_SCAM_HISTORY": 10,
    "LOW_RISK_CLUSTER": 8,
    "FAR_FROM_SCAM_CLUSTER": 6,
    "LONG_HISTORY": 10,
    "LONG_TERM_ACTIVE": 10,
    "NFT_COLLECTOR": 5,
    "DEX_TRADER": 5,
    "DAO_MEMBER": 5,
    "HIGH_BALANCE_HISTORY": 5,
    "MULTI_YEAR_ACTIVITY": 10,
    "WHALE_100_SOL": 3,
    "WHALE_1K_SOL": 5,
    "WHALE_5K_SOL": 8,
    "WHALE_10K_SOL": 10,
    "WHALE_50K_SOL": 12,
    "LONG_TERM_BALANCE": 5,
    "DEX_TRADER_10_PLUS": 3,
    "DEX_TRADER_50_PLUS": 5,
    "DEX_TRADER_100_PLUS": 8,
    "DEX_TRADER_200_PLUS": 10,
    "DEX_TRADER_500_PLUS": 12,
    "DEX_HIGH_VOLUME": 5,
    "DEX_LONG_TERM_ACTIVITY": 5,
    "NFT_10_PLUS": 3,
    "NFT_50_PLUS": 5,
    "NFT_100_PLUS": 8,
    "NFT_200_PLUS": 10,
    "NFT_500_PLUS": 12,
    "NFT_VERIFIED_COLLECTION": 5,
    "NFT_TRADER_ACTIVE": 5,
    "AGE_1Y": 5,
    "AGE_3Y": 10,
    "AGE_5Y": 15,
    "AGE_7Y": 18,
    "AGE_10Y": 20,
}

# --- fixed values: risk weights of evidence counts -------------------------------------
EVIDENCE_RISK = {
    "SCAM_CLUSTER_MEMBER": 40,
    "DRAINER_INTERACTION": 20,
    "HIGH_VALUE_OUTFLOW": 10,
    "NEW_WALLET": 5,
    "LOW_ACTIVITY": 3,
}

# --- fixed values: likelihood factors of the odds update -------------------------------
LIKELIHOODS = {
    "SCAM_CLUSTER_MEMBER": 5.0,
    "SCAM_CLUSTER_MEMBER_SMALL": 3.0,
    "SCAM_CLUSTER_MEMBER_LARGE": 7.0,
    "DRAINER_INTERACTION": 8.0,
    "HIGH_VOLUME_TO_SCAM": 8.0,
    "DRAINER_FLOW": 10.0,
    "DRAINER_FLOW_DETECTED": 6.0,
    "HIGH_VALUE_OUTFLOW": 4.0,
    "BRIDGE_SCAM_INTERACTION": 6.0,
    "LOW_ACTIVITY": 1.2,
    "NEW_WALLET": 1.1,
    "CLEAN_HISTORY": 0.5,
    "NO_RISK_DETECTED": 0.3,
}
DEFAULT_PRIOR = 0.05

# --- fixed values: code sets -------------------------------------------------------------
WEAK_CODES = frozenset({"LOW_ACTIVITY", "NEW_WALLET", "CLEAN_HISTORY", "NO_RISK_DETECTED"})
HIGH_RISK_CODES = frozenset({
    "SCAM_CLUSTER_MEMBER", "SCAM_CLUSTER_MEMBER_SMALL", "SCAM_CLUSTER_MEMBER_LARGE", "RUG_PULL_DEPLOYER",
    "BLACKLISTED_CREATOR", "DRAINER_FLOW_DETECTED", "DRAINER_FLOW", "MEGA_DRAINER",
})
FORCED_NEGATIVE_CODES = HIGH_RISK_CODES | {"HIGH_RISK_TOKEN_INTERACTION", "SUSPICIOUS_TOKEN_MINT"}
SCAM_TRIGGERS = frozenset({
    "SCAM_CLUSTER_MEMBER", "SCAM_CLUSTER_MEMBER_SMALL", "SCAM_CLUSTER_MEMBER_LARGE", "RUG_PULL_DEPLOYER",
    "DRAINER_FLOW_DETECTED", "DRAINER_FLOW", "MEGA_DRAINER", "BLACKLISTED_CREATOR",
    "HIGH_RISK_TOKEN_INTERACTION", "TRANSFER_TO_SCAM",
})
SUSPICIOUS_CODES = frozenset({
    "SCAM_CLUSTER_MEMBER", "SCAM_CLUSTER_MEMBER_SMALL", "SCAM_CLUSTER_MEMBER_LARGE", "DRAINER_INTERACTION",
    "DRAINER_FLOW", "DRAINER_FLOW_DETECTED", "MEGA_DRAINER", "RUG_PULL_DEPLOYER", "BLACKLISTED_CREATOR",
    "HIGH_RISK_TOKEN_INTERACTION",
})
CLEAN_CODES = frozenset({"CLEAN_HISTORY", "NO_RISK_DETECTED"})
CRITICAL_CODES = frozenset({"RUG_PULL_DEPLOYER", "MEGA_DRAINER"})
CLUSTER_CODES = frozenset({"SCAM_CLUSTER_MEMBER", "SCAM_CLUSTER_MEMBER_SMALL", "SCAM_CLUSTER_MEMBER_LARGE"})
NO_RISK = "NO_RISK_DETECTED"

# --- fixed values: anomaly severities ----------------------------------------------------
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_PENALTY = {"critical": 25.0, "high": 15.0, "medium": 8.0, "low": 3.0}
ALERT_SEVERITY_PENALTY = {"critical": 6.0, "high": 4.0, "medium": 2.0, "low": 1.0}


@dataclass(frozen=True)
class AnomalyConfig:
    """Limits as (critical, high, medium)."""

    burst_per_day: tuple[float, float, float] = (100.0, 50.0, 20.0)
    velocity_sol: tuple[float, float, float] = (500.0, 200.0, 50.0)
    fresh_max_tx: int = 5
    fresh_sol: tuple[float, float, float] = (100.0, 50.0, 10.0)


@dataclass(frozen=True)
class PropagationConfig:
    penalties: tuple[int, int, int] = (-40, -20, -5)
    scale: float = 1.0
    decay_days: float = 30.0
    max_depth: int = 3


@dataclass(frozen=True)
class NeighborPenaltyConfig:
    max_hops: int = 2
    base: float = 6.0
    decay: float = 0.5
    cap: float = 20.0


@dataclass(frozen=True)
class ClusterConfig:
    min_fan: int = 2
    min_tx: int = 2
    window_s: int = 604_800
    max_buckets: int | None = None  # newest buckets only, when set
    min_confidence: float = 0.3
    max_edges: int | None = None  # newest edges only, when set


@dataclass(frozen=True)
class EscalationConfig:
    recent_s: int = 172_800
    cluster_s: int = 3_600
    clean_reduce_s: int = 86_400
    clean_reset_s: int = 172_800
    normal_max: float = 30.0
    warning_max: float = 60.0
    cap: float = 100.0
    per_flag: float = 6.0
    repeated: float = 8.0
    multiple_types: float = 12.0
    time_cluster: float = 15.0
    decay: float = 12.0
    cluster_alerts: int = 3


@dataclass(frozen=True)
class AlertConfig:
    score_below: float = 50.0
    cooldown_s: int = 3_600
    max_reason: int = 500


# --- fixed values: badge bands (lower bound, name, colour), highest first ----------------
BADGE_FIVE = [
    (80, "EXCELLENT", "#10b981"),
    (60, "TRUSTED", "#22c55e"),
    (40, "CAUTION", "#eab308"),
    (20, "HIGH_RISK", "#f97316"),
    (0, "SCAM_SUSPECTED", "#ef4444"),
]
BADGE_FOUR = [
    (80, "Trusted", "green"),
    (50, "Caution", "yellow"),
    (20, "Risky", "orange"),
    (0, "Scam Suspected", "red"),
]
BADGE_TRANSFER = [
    (70, "TRUSTED", ""),
    (50, "LOW_RISK", ""),
    (30, "MEDIUM_RISK", ""),
    (10, "HIGH_RISK", ""),
    (0, "SCAM_SUSPECTED", ""),
]
RISK_TEXT = {"0": "Low Risk", "1": "Moderate Risk", "2": "High Risk", "3": "Critical Risk"}

# --- fixed values: explanation texts -----------------------------------------------------
REASON_TEMPLATES = {
    "SCAM_CLUSTER_MEMBER": "This wallet interacted with a cluster linked to scam wallets within the last 30 days.",
    "NEW_WALLET": "This wallet is newly created and has limited transaction history.",
    "LOW_ACTIVITY": "This wallet has very low activity, which increases uncertainty in trust evaluation.",
    "HIGH_VOLUME_TO_SCAM": "This wallet transferred significant funds to a wallet flagged as scam.",
    "NO_RISK_DETECTED": "No significant risk indicators were detected for this wallet.",
    "SCAM_DISTANCE": "This wallet is 1-3 hops away from a scam wallet.",
    "DRAINER_TX": "This wallet exhibited drainer-like transaction patterns.",
    "RUG_PULL_DEPLOYER": "This wallet is associated with rug pull deployment activity.",
    "CLEAN_HISTORY": "No suspicious activity detected in transaction history.",
}
NEGATIVE_PHRASES = {
    "SCAM_CLUSTER_MEMBER": "connected to known scam cluster",
    "RUG_PULL_SIMULATION": "involved in rug-pull simulation",
    "DRAINER_FLOW_DETECTED": "linked to drainer activity",
    "BLACKLISTED_CREATOR": "created scam token",
}
POSITIVE_PHRASES = {
    "CLEAN_HISTORY": "no suspicious activity detected",
    "NO_RISK_DETECTED": "wallet appears safe",
}
FINAL_PHRASES = {
    "SCAM_CLUSTER_MEMBER": "Wallet connected to known scam cluster",
    "DRAINER_TX": "Wallet interacted with drainer address",
    "TRANSFER_TO_SCAM": "Wallet transferred funds to scam wallet",
    "CLEAN_HISTORY": "No suspicious transaction history",
    "LOW_ACTIVITY": "Wallet has low transaction history",
}
BADGE_PHRASES = {
    "SCAM_CLUSTER_MEMBER": "cluster link",
    "SCAM_CLUSTER_MEMBER_SMALL": "cluster link",
    "SCAM_CLUSTER_MEMBER_LARGE": "cluster link",
    "DRAINER_INTERACTION": "drainer interaction",
    "DRAINER_FLOW": "drainer flow",
    "DRAINER_FLOW_DETECTED": "drainer activity",
    "MEGA_DRAINER": "mega drainer",
    "RUG_PULL_DEPLOYER": "rug pull deployment",
    "BLACKLISTED_CREATOR": "blacklisted creator",
    "HIGH_RISK_TOKEN_INTERACTION": "high-risk token interaction",
    "HIGH_VOLUME_TO_SCAM": "high-volume transfers to scam",
}
LABEL_SCORES = {
    "NEW_WALLET": (80, 1),
    "HIGH_OUTFLOW": (60, 2),
    "DRAINER_INTERACTION": (40, 3),
    "SCAM_CLUSTER_MEMBER": (10, 5),
}
REASON_EVENTS = {
    "SCAM_CLUSTER_MEMBER": "Wallet linked to scam cluster",
    "SCAM_CLUSTER_MEMBER_SMALL": "Wallet linked to scam cluster",
    "SCAM_CLUSTER_MEMBER_LARGE": "Wallet linked to scam cluster",
    "HIGH_PROPAGATION_RISK": "High propagation risk detected",
    "RISKY_INTERACTION": "Interacted with risky wallet",
    "DRAINER_INTERACTION": "Interacted with risky wallet",
    "DRAINER_FLOW": "Drainer flow detected",
    "DRAINER_FLOW_DETECTED": "Drainer flow detected",
    "RUG_PULL_DEPLOYER": "Rug pull deployer detected",
    "BLACKLISTED_CREATOR": "Blacklisted creator detected",
    "NEW_WALLET": "New wallet detected",
    "LOW_ACTIVITY": "Low activity wallet",
    "CLEAN_HISTORY": "Clean history confirmed",
    "LONG_TERM_ACTIVE": "Long-term active wallet",
}
REASON_EVENT_RISK = {
    "SCAM_CLUSTER_MEMBER": "CRITICAL",
    "SCAM_CLUSTER_MEMBER_SMALL": "HIGH",
    "SCAM_CLUSTER_MEMBER_LARGE": "CRITICAL",
    "MEGA_DRAINER": "CRITICAL",
    "RUG_PULL_DEPLOYER": "CRITICAL",
    "DRAINER_FLOW": "CRITICAL",
    "DRAINER_FLOW_DETECTED": "CRITICAL",
    "BLACKLISTED_CREATOR": "CRITICAL",
    "HIGH_PROPAGATION_RISK": "HIGH",
    "HIGH_RISK_TOKEN_INTERACTION": "HIGH",
    "SUSPICIOUS_TOKEN_MINT": "HIGH",
    "DRAINER_INTERACTION": "HIGH",
    "RISKY_INTERACTION": "MEDIUM",
    "HIGH_VALUE_OUTFLOW": "MEDIUM",
    "UNKNOWN_TOKEN": "LOW",
    "NEW_WALLET": "LOW",
    "LOW_ACTIVITY": "LOW",
    "CLEAN_HISTORY": "LOW",
    "LONG_TERM_ACTIVE": "LOW",
}
EVENT_SEVERITY = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
PATTERN_LABELS = {
    "SCAM_CLUSTER_MEMBER": "Cluster-linked wallet",
    "SCAM_CLUSTER_MEMBER_SMALL": "Cluster-linked wallet",
    "SCAM_CLUSTER_MEMBER_LARGE": "Cluster-linked wallet",
    "HIGH_PROPAGATION_RISK": "High network exposure",
    "LOW_ACTIVITY": "Long-term holder",
    "NEW_WALLET": "New wallet",
    "CLEAN_HISTORY": "Clean history",
    "LONG_TERM_ACTIVE": "Long-term active",
    "DEX_TRADER": "DEX trader",
    "NFT_COLLECTOR": "NFT collector",
}
DEFAULT_PATTERN = ["No suspicious activity detected", "Limited transaction history"]

# --- fixed values: recommended actions ---------------------------------------------------
ACTIONS_BY_CATEGORY = {
    "SELF_RISK": [
        "Review recent counterparties for suspicious activity.",
        "Avoid interacting with flagged or high-risk entities.",
        "Disconnect unknown token approvals and monitor wallet permissions.",
        "Reassess cluster-related transaction patterns.",
    ],
    "NETWORK_EXPOSED": [
        "Reduce exposure to high-risk counterparties.",
        "Diversify transaction activity across trusted protocols.",
        "Monitor network risk signals and cluster changes.",
    ],
    "CLEAN": [
        "Maintain consistent and healthy transaction behavior.",
        "Avoid interaction with newly flagged high-risk wallets.",
        "Continue long-term on-chain activity to strengthen reputation.",
    ],
}
ACTIONS_INTRINSIC_HIGH = [
    "Review recent wallet activity carefully.",
    "Avoid high-risk token or contract interactions.",
    "Monitor on-chain exposure trends.",
]
ACTIONS_CONTEXTUAL_HIGH = [
    "Monitor exposure to risky counterparties.",
    "Limit interaction with flagged wallet clusters.",
    "Diversify network relationships.",
]
ACTIONS_DEFAULT = [
    "Monitor wallet activity regularly.",
    "Maintain interaction with trusted protocols.",
    "Review exposure before large transactions.",
]
