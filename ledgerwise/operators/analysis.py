"""Wallet analysis over raw transactions: metrics, type, risk flags, detectors and rule score.

Operators read all transactions.  A caller may limit them to the newest N per wallet; the limits come from one
ranking (``ranked_tx``): pass its result to several operators and the wallet is ranked once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions.common import DAY, LAMPORTS_PER_SOL, assemble, clamp, codes, newest_n, rnd
from ledgerwise.sources.transactions import own_balance_change, programs_of

# fixed values: wallet types in the order of their feature index
WALLET_TYPES = ["cold_wallet", "service_wallet", "trader_wallet", "nft_wallet", "inactive_wallet", "unknown"]
PROTECTED = ("cold_wallet", "service_wallet")


def ranked_tx(tx_raw: DataFrame, n: int | None = None) -> DataFrame:
    """The newest ``n`` transactions of each wallet with their rank ``_rn``; all of them, as they are, without ``n``."""
    if n is None:
        return tx_raw
    if "_rn" in tx_raw.columns:
        return tx_raw.filter(F.col("_rn") <= n)
    return newest_n(tx_raw, ["wallet"], [F.coalesce("block_time", F.lit(0)).desc(), F.col("signature").desc()], n,
                    rank="_rn", salt_cols=["signature"])


def wallet_metrics(tx_raw: DataFrame, token_accounts: DataFrame, as_of: int, n: int | None = None,
                   n_programs: int | None = None) -> DataFrame:
    tx = ranked_tx(tx_raw, n)
    age = F.floor((F.lit(as_of) - F.min("block_time")) / DAY)
    base = tx.groupBy("wallet").agg(F.count(F.lit(1)).alias("tx_count"),
                                    F.greatest(F.lit(0), age).alias("wallet_age_days"))
    programs = ranked_tx(tx, n_programs).select("wallet", F.explode(programs_of()).alias("p")).groupBy(
        "wallet").agg(F.count_distinct("p").alias("unique_programs"))
    held = token_accounts.filter("mint IS NOT NULL").groupBy("wallet").agg(F.count(F.lit(1)).alias("token_accounts"))
    return assemble(base, programs, held).fillna(0, ["unique_programs", "token_accounts"])


def avg_tx_value(tx_raw: DataFrame, n: int | None = None) -> DataFrame:
    change = F.abs(own_balance_change())
    return ranked_tx(tx_raw, n).groupBy("wallet").agg(
        F.coalesce(F.try_divide(F.sum(change), F.count(change)) / float(LAMPORTS_PER_SOL), F.lit(0.0)).alias("sol"))


def dex_lp_interactions(tx_raw: DataFrame, dex: list[str], lp: list[str], n: int | None = None) -> DataFrame:
    used = programs_of()
    touches = lambda ids: F.arrays_overlap(used, F.array(*[F.lit(x) for x in ids]))
    return ranked_tx(tx_raw, n).groupBy("wallet").agg(
        F.count_if(touches(dex)).alias("dex"), F.count_if(touches(lp)).alias("lp"))


def nft_count(token_accounts: DataFrame) -> DataFrame:
    return token_accounts.groupBy("wallet").agg(
        F.count_if((F.col("decimals") == 0) & (F.col("amount") == 1)).alias("n"))


def _counterparties(tx: DataFrame, known: list[str], min_len: int) -> DataFrame:
    key = F.col("key")
    rows = tx.select("wallet", F.explode("account_keys").alias("key"))
    return rows.filter((F.length(key) >= min_len) & (key != F.col("wallet")) & ~key.isin(*known))


def cluster_size_estimate(tx_raw: DataFrame, known: list[str], n: int | None = None, min_len: int = 32) -> DataFrame:
    tx = ranked_tx(tx_raw, n)
    found = _counterparties(tx, known, min_len).groupBy("wallet").agg(F.count_distinct("key").alias("n"))
    return tx.select("wallet").distinct().join(found, "wallet", "left").select(
        "wallet", F.greatest(F.lit(1), F.coalesce("n", F.lit(0))).alias("n"))


def wallet_type_of() -> Column:
    tx, age, programs = F.col("tx_count"), F.col("wallet_age_days"), F.col("unique_programs")
    kind = (
        F.when(F.col("token_accounts") > 20, "nft_wallet")
        .when((tx < 10) & (age > 365), "cold_wallet")
        .when((tx > 500) & (programs <= 5), "service_wallet")
        .when((tx > 200) & (programs > 10), "trader_wallet")
        .when(tx < 3, "inactive_wallet")
        .when((tx < 5) & (age < 90), "inactive_wallet")
        .otherwise("unknown")
    )
    return kind


def classify_wallet(metrics: DataFrame) -> DataFrame:
    return metrics.select("wallet", wallet_type_of().alias("wallet_type"))


def risk_flags(metrics: DataFrame, types: DataFrame) -> DataFrame:
    return with_risk_flags(metrics.join(types, "wallet", "left")).select("wallet", "flags", "risk_level")


def with_risk_flags(m: DataFrame) -> DataFrame:
    """Adds ``flags`` and ``risk_level`` to rows with metrics and ``wallet_type``."""
    free = ~F.coalesce(F.col("wallet_type").isin(*PROTECTED), F.lit(False))
    flags = codes(
        (F.col("wallet_age_days") < 3, "new_wallet"),
        (free & (F.col("tx_count") < 5), "low_activity"),
        (free & (F.col("unique_programs") == 0), "inactive"),
        (F.col("token_accounts") > 100, "suspicious_distribution"),
    )
    n = F.size("flags")
    return m.withColumn("flags", flags).withColumn(
        "risk_level", F.when(n == 0, "LOW").when(n <= 2, "MEDIUM").otherwise("HIGH"))


def scam_program_interactions(tx_raw: DataFrame, blacklist: DataFrame, n: int | None = None) -> DataFrame:
    """Transactions that touch a blacklisted program.  The blacklist is joined by its key; Spark
    broadcasts it only when its measured size allows."""
    tx = ranked_tx(tx_raw, n)
    bad = blacklist.select(F.col("program_id").alias("p")).distinct()
    hits = tx.select("wallet", "signature", F.explode(programs_of()).alias("p")).join(bad, "p", "left_semi")
    found = hits.groupBy("wallet").agg(F.count_distinct("signature").alias("interactions"),
                                       F.array_sort(F.collect_set("p")).alias("programs"))
    return tx.select("wallet").distinct().join(found, "wallet", "left").select(
        "wallet", F.coalesce("interactions", F.lit(0)).alias("interactions"),
        F.coalesce("programs", F.array().cast("array<string>")).alias("programs"))


def rugpull_holdings(token_accounts: DataFrame, blacklist: DataFrame) -> DataFrame:
    held = token_accounts.join(blacklist.select("mint").distinct(), "mint", "left_semi")
    return held.groupBy("wallet").agg(F.count(F.lit(1)).alias("interactions"),
                                      F.array_sort(F.collect_set("mint")).alias("tokens"))


def _dropped_mints() -> Column:
    """Mints of the wallet's own balances that fell in a transaction.

    Balances before and after are sorted by account, those before first; one fold keeps the largest balance before of the
    present account, so the cost is that of a sort, not of all pairs.
    """
    entry = lambda b, side, mint: F.struct(
        b["account_index"].cast("bigint").alias("at"), F.lit(side).alias("side"), b["ui_amount"].cast("double").alias("amount"), mint.alias("mint"))
    none = F.lit(None).cast("string")
    before = F.transform("token_balances_pre", lambda b: entry(b, 0, none))
    own = F.filter("token_balances_post", lambda b: b["owner"] == F.col("wallet"))
    after = F.transform(own, lambda b: entry(b, 1, b["mint"]))
    both = F.array_sort(F.concat(F.coalesce(before, F.array().cast("array<struct<at:bigint,side:int,amount:double,mint:string>>")), after))
    start = F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("double").alias("most"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        same = F.coalesce(s["at"] == e["at"], F.lit(False))
        fell = F.coalesce(same & (e["side"] == 1) & (s["most"] > e["amount"]), F.lit(False))
        most = F.when(e["side"] == 1, s["most"]).when(same, F.greatest(s["most"], e["amount"])).otherwise(e["amount"])
        return F.struct(F.when(e["side"] == 1, s["at"]).otherwise(e["at"]).alias("at"), most.alias("most"),
                        F.when(fell, F.concat(s["out"], F.array(e["mint"]))).otherwise(s["out"]).alias("out"))

    return F.aggregate(both, start, step, lambda s: s["out"])


def nft_scam_role(token_accounts: DataFrame, tokens: DataFrame, tx_raw: DataFrame, collections: DataFrame,
                  max_nfts: int | None = None, n: int | None = None, mass: int = 10) -> DataFrame:
    nfts = token_accounts.filter("decimals = 0 AND amount = 1")
    if max_nfts is not None:
        nfts = newest_n(nfts, ["wallet"], [F.col("mint")], max_nfts)
    scam = tokens.join(collections.select("collection").distinct(), "collection", "left_semi").select(
        "mint", "mint_authority", "creator_wallets")
    held = nfts.select("wallet", "mint").join(scam, "mint")
    roles = held.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("mint_authority") == F.col("wallet")).alias("minted"),
        F.coalesce(F.bool_or(F.array_contains("creator_wallets", F.col("wallet"))), F.lit(False)).alias("is_creator"),
    )
    sent = ranked_tx(tx_raw, n).select("wallet", F.explode(_dropped_mints()).alias("mint"))
    out = sent.join(held.select("wallet", "mint"), ["wallet", "mint"], "left_semi").groupBy("wallet").agg(
        F.count(F.lit(1)).alias("distributed"))
    all_wallets = token_accounts.select("wallet").distinct()
    full = all_wallets.join(roles, "wallet", "left").join(out, "wallet", "left").fillna(
        {"received": 0, "minted": 0, "distributed": 0, "is_creator": False})
    role = (
        F.when((F.col("minted") > 0) | F.col("is_creator") | (F.col("distributed") >= mass), "scammer")
        .when((F.col("received") > 0) & (F.col("distributed") > 0), "participant")
        .when(F.col("received") > 0, "victim").otherwise("none")
    )
    return full.select("wallet", "received", "minted", "distributed", "is_creator", role.alias("role"))


# neutral detector outputs of a wallet without findings
NO_FINDINGS = {"scam_interactions": 0, "rugpull_interactions": 0, "nft_role": "none", "received": 0, "is_creator": False,
               "cluster_size": 1, "cluster_risk": "LOW"}


def detector_parts(scam: DataFrame, rugpull: DataFrame, nft: DataFrame, cluster: DataFrame) -> list[DataFrame]:
    """Detector outputs with distinct column names, ready for ``assemble``."""
    return [
        scam.select("wallet", F.col("interactions").alias("scam_interactions"), "programs"),
        rugpull.select("wallet", F.col("interactions").alias("rugpull_interactions")),
        nft.select("wallet", F.col("role").alias("nft_role"), "received", "is_creator"),
        cluster.select("wallet", "cluster_size", "cluster_risk"),
    ]


def detector_table(metrics: DataFrame, scam: DataFrame, rugpull: DataFrame, nft: DataFrame,
                   cluster: DataFrame) -> DataFrame:
    """Detector outputs side by side, one row per analysed wallet."""
    return assemble(metrics.select("wallet"), *detector_parts(scam, rugpull, nft, cluster)).fillna(NO_FINDINGS)


def rule_trust_score(metrics: DataFrame, risk: DataFrame, detectors: DataFrame) -> DataFrame:
    df = metrics.join(risk, "wallet").join(detectors, "wallet")
    return with_rule_score(df).select("wallet", "score", "risk_label")


def with_rule_score(df: DataFrame) -> DataFrame:
    """Adds ``score`` and ``risk_label`` to rows with metrics, risk flags and detector columns."""
    forced = (
        F.when(F.col("scam_interactions") > 0, 40).when(F.col("nft_role") == "scammer", 35)
        .when(F.col("cluster_risk") == "HIGH", 50)
    )
    score = (
        40 + F.least(F.floor(F.col("tx_count") / 10), F.lit(30)) + F.least(F.floor(F.col("wallet_age_days") / 30), F.lit(20))
        + F.least(F.col("unique_programs") * 2, F.lit(20)) - F.size("flags") * 15
        - F.coalesce(forced, F.lit(0)) - F.when(F.col("rugpull_interactions") > 0, 30).otherwise(0)
    )
    return df.withColumns({"score": clamp(score, 0, 100).cast("int"),
                           "risk_label": F.when(forced.isNotNull(), "HIGH").otherwise(F.col("risk_level"))})


def rule_reason_codes(risk: DataFrame, detectors: DataFrame, types: DataFrame) -> DataFrame:
    df = risk.join(detectors, "wallet").join(types, "wallet")
    return df.select("wallet", rule_codes_of().alias("reason_codes"))


def rule_codes_of() -> Column:
    has = lambda f: F.array_contains("flags", f)
    scam, rug = F.col("scam_interactions") > 0, F.col("rugpull_interactions") > 0
    listed = codes(
        (has("new_wallet"), "NEW_WALLET"), (has("low_activity") | has("inactive"), "LOW_ACTIVITY"),
        (scam, "KNOWN_SCAM_PROGRAM"), (scam | rug, "RUG_PULL_TOKEN"), (F.col("cluster_risk") == "HIGH", "SCAM_CLUSTER"),
        (F.col("nft_role") == "scammer", "SCAM_NFT_CREATOR"), (F.col("received") > 0, "SCAM_NFT_RECEIVED"),
        (F.col("is_creator"), "SCAM_NFT_CREATOR"), (F.col("wallet_type") == "service_wallet", "SERVICE_WALLET"),
        (F.col("wallet_type") == "cold_wallet", "COLD_WALLET"),
    )
    return F.array_distinct(listed)


def _capped(c: Column | str, scale: float, cap: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.least(F.coalesce(c, F.lit(0)).cast("double") / scale, F.lit(cap))


# fixed values: feature names in vector order
FEATURE_NAMES = [
    "wallet_age_days", "tx_count", "unique_programs", "token_accounts", "nft_count", "scam_interactions",
    "rugpull_interactions", "cluster_size", "wallet_type_encoded", "avg_tx_value", "dex_interaction_count",
    "lp_interaction_count", "unique_counterparties", "cluster_size_estimate", "scam_cluster_flag",
]


def normalized_features(analysis: DataFrame) -> DataFrame:
    """The 15 scaled model inputs; wallets without a transaction count or age are left out."""
    df = analysis.filter("tx_count IS NOT NULL AND wallet_age_days IS NOT NULL")
    nft = F.coalesce(F.col("nft_count"), F.lit(0))
    nft = F.when((nft == 0) & (F.col("token_accounts") > 0), F.col("token_accounts")).otherwise(nft)
    kinds = F.array(*[F.lit(t) for t in WALLET_TYPES])
    index = F.array_position(kinds, F.col("wallet_type")) - 1
    size = F.coalesce(F.nullif("cluster_size", F.lit(0)), F.lit(1))
    estimate = F.coalesce(F.nullif("cluster_size_estimate", F.lit(0)), F.nullif("cluster_size", F.lit(0)), F.lit(1))
    return df.select(
        "wallet",
        _capped("wallet_age_days", 365, 5).alias("wallet_age_days"), _capped("tx_count", 1000, 5).alias("tx_count"),
        _capped("unique_programs", 20, 5).alias("unique_programs"),
        _capped("token_accounts", 20, 5).alias("token_accounts"), _capped(nft, 50, 1).alias("nft_count"),
        _capped("scam_interactions", 10, 5).alias("scam_interactions"),
        _capped("rugpull_interactions", 10, 5).alias("rugpull_interactions"),
        _capped(size, 10, 5).alias("cluster_size"),
        F.when(index >= 0, index).otherwise(5).cast("double").alias("wallet_type_encoded"),
        _capped("avg_tx_value", 10, 1).alias("avg_tx_value"),
        _capped("dex_interaction_count", 100, 1).alias("dex_interaction_count"),
        _capped("lp_interaction_count", 20, 1).alias("lp_interaction_count"),
        _capped("unique_counterparties", 100, 5).alias("unique_counterparties"),
        _capped(estimate, 50, 1).alias("cluster_size_estimate"),
        F.when(F.upper("cluster_risk") == "HIGH", 1.0).otherwise(0.0).alias("scam_cluster_flag"),
    )


def basic_ml_features(tx_raw: DataFrame, as_of: int, n: int | None = None, n_keys: int | None = None) -> DataFrame:
    tx = ranked_tx(tx_raw, n)
    base = tx.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("total_tx"),
        F.coalesce(F.floor((F.lit(as_of) - F.min("block_time")) / DAY), F.lit(0)).cast("int").alias("account_age_days"))
    keys = _counterparties(ranked_tx(tx, n_keys), [""], 1).groupBy("wallet").agg(
        F.count_distinct("key").alias("unique_counterparties"))
    return base.join(keys, "wallet", "left").fillna(0, ["unique_counterparties"])


def token_features(tokens: DataFrame) -> DataFrame:
    flagged = F.col("mint_authority").isNotNull() | F.col("freeze_authority").isNotNull() | F.col("metadata_missing")
    return tokens.withColumn("scam_flag", flagged).withColumn("creator_wallets", F.concat_ws(";", "creator_wallets"))


def derive_scam_wallets(tokens: DataFrame, scam: DataFrame, label: str = "scam",
                        source: str = "token_scan") -> DataFrame:
    """Creators of flagged tokens that are not known yet."""
    creators = tokens.filter("scam_flag").select(F.explode("creator_wallets").alias("wallet")).distinct()
    return creators.join(scam.select("wallet"), "wallet", "left_anti").withColumns(
        {"label": F.lit(label), "source": F.lit(source)})


def tx_reason_detect(tx_raw: DataFrame, scam: DataFrame, programs: list[str], known: DataFrame,
                     min_sol: float = 10.0) -> DataFrame:
    """Reason codes of each new transaction (wallet, code, tx_hash, created_at)."""
    fresh = tx_raw.join(known.select(F.col("tx_hash").alias("signature")).distinct(), "signature", "left_anti")
    floor = int(min_sol * LAMPORTS_PER_SOL)
    mint = F.upper("type").isin("TOKEN_MINT", "MINT") | F.exists("instructions", lambda i: F.lower(i["type"]) == "mint")
    large = F.exists("instructions", lambda i: (i["source"] == F.col("wallet")) & (i["lamports"] >= floor))
    shady = F.exists("instructions", lambda i: i["program_id"].isin(*programs))
    bad = scam.select(F.col("wallet").alias("party")).distinct()
    parties = F.array_distinct(F.flatten(F.transform("instructions", lambda i: F.array(i["source"], i["destination"]))))
    touched = fresh.select("signature", F.explode(parties).alias("party")).join(bad, "party", "left_semi").select(
        "signature").distinct().withColumn("_scam", F.lit(True))
    rows = fresh.join(touched, "signature", "left")
    found = codes(
        (F.lower("description").contains("rug") & mint, "RUG_PULL_DEPLOYER"),
        (large | shady | F.coalesce("_scam", F.lit(False)), "DRAINER_TX"), (mint, "SCAM_TOKEN_MINT"),
    )
    return rows.select("wallet", F.explode(found).alias("reason_code"), F.col("signature").alias("tx_hash"),
                       F.col("block_time").alias("created_at"))


def token_vector(holdings: DataFrame, tokens: DataFrame) -> DataFrame:
    t = tokens.select("mint", "mint_authority", "freeze_authority", "metadata_missing", "decimals", "supply")
    held = holdings.select("wallet", "mint").join(t, "mint")
    flag = lambda c: F.max(c.cast("double"))
    mean = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).cast("double") / F.count(c)
    return held.groupBy("wallet").agg(
        flag(F.col("mint_authority").isNotNull()).alias("mint_authority"),
        flag(F.col("freeze_authority").isNotNull()).alias("freeze_authority"),
        flag(F.col("metadata_missing")).alias("metadata_missing"),
        mean("decimals").alias("decimals"), mean("supply").alias("supply"),
    )
