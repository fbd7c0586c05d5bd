"""Reason codes: derivation, counting, defaults, weights and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import DAY, clamp, codes, in_set, lookup, newest_n, rnd, title_case
from ledgerwise.functions.scores import badge, risk_level


def feature_join(cluster: DataFrame, flow: DataFrame, drainer: DataFrame, how: str = "outer") -> DataFrame:
    """Feature tables side by side; text columns are read as numbers, missing values become 0."""
    df = cluster.join(flow, "wallet", how).join(drainer, "wallet", how)
    numeric = [F.when(F.col(c).isNull(), 0.0).otherwise(F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)))
               .alias(c) for c in df.columns if c != "wallet"]
    return df.select("wallet", *numeric)


def feature_reason_codes(joined: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Ordered distinct codes of five rule groups; a column that is absent counts as its neutral value."""
    def num(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in joined.columns else F.lit(default)

    total, rapid_out = num("total_tx"), num("rapid_outflow_count")
    age = F.greatest(num("account_age_days"), num("wallet_age_days"))
    distance = num("distance_to_scam", 999.0)
    if strict_reference:
        distance = F.when(distance == 0, 999.0).otherwise(distance)
    member = num("is_scam_cluster_member")
    own_age = num("wallet_age_days")
    year = 365
    band = (F.when(age >= 10 * year, "AGE_10Y").when(age >= 7 * year, "AGE_7Y").when(age >= 5 * year, "AGE_5Y")
            .when(age >= 3 * year, "AGE_3Y").when(age >= year, "AGE_1Y"))
    clean, far, long = member == 0, distance >= 3, own_age >= year
    near = num("distance_to_scam", -1.0).between(0, 1)
    listed = codes(
        ((num("scam_neighbor_count") >= 1) | near, "NEAR_SCAM_CLUSTER"),
        (num("percent_to_same_cluster") >= 50, "HIGH_CLUSTER_CONTAMINATION"),
        (member == 1, "SCAM_CLUSTER_MEMBER"),
        (total < 3, "NEW_WALLET"),
        ((total < 3) | (num("unique_destinations") < 2), "LOW_ACTIVITY"),
        (num("rapid_tx_count") >= 5, "HIGH_RAPID_TX"),
        ((num("percent_to_new_wallets") >= 70) & (rapid_out > 0), "LARGE_OUTFLOW_TO_NEW_WALLET"),
        (num("wash_trade_count") >= 1, "WASH_TRADE_PATTERN"),
        (num("approval_like_count") >= 1, "HIGH_APPROVAL_RISK"),
        (rapid_out > 0, "SUDDEN_DRAIN_PATTERN"),
        (rapid_out >= 3, "RAPID_TOKEN_DUMP"),
        (num("multi_victim_pattern") > 0, "MULTI_VICTIM_PATTERN"),
        (num("new_contract_interaction_count") > 0, "NEW_CONTRACT_INTERACTION"),
        (num("swap_then_transfer_pattern") > 0, "SWAP_THEN_TRANSFER"),
        (num("drainer_interaction_count") > 0, "DRAINER_INTERACTION"),
        (num("rugpull_deployer") > 0, "RUGPULL_DEPLOYER"),
        (band.isNotNull(), band),
        (clean, "NO_SCAM_HISTORY"), (clean, "LOW_RISK_CLUSTER"),
        (far, "FAR_FROM_SCAM_CLUSTER"), (long, "LONG_HISTORY"),
        (~(clean | far | long), "CLEAN_HISTORY"),
    )
    return joined.select("wallet", F.array_distinct(listed).alias("codes"))


def _ordered_counts(rows: DataFrame) -> DataFrame:
    """(wallet, entries): one struct(code, n) per code, most frequent first, then by code."""
    counts = rows.groupBy("wallet", "code").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct((-F.col("n")).alias("k"), "code", "n")
    return counts.groupBy("wallet").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def reason_frequency(code_rows: DataFrame, weights: dict[str, float] | None = None,
                     default: float = 0.5) -> DataFrame:
    """Rows (wallet, code) to ordered codes, counts, top 3 and the scaled weighted score."""
    w = weights or {}
    weight = F.coalesce(lookup(w, F.col("code")), F.lit(default)) if w else F.lit(default)
    scores = code_rows.groupBy("wallet", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("wallet").agg(
        rnd(F.least(F.lit(100.0), F.sum((weight * F.col("n")).cast("decimal(20,6)")).cast("double") * 20.0), 2)
        .alias("weighted_risk_score"))
    listed = F.transform("entries", lambda e: e["code"])
    return _ordered_counts(code_rows).join(scores, "wallet").select(
        "wallet", listed.alias("reason_codes"),
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["code"], e["n"]))).alias("reason_freq"),
        F.array_join(F.slice(listed, 1, 3), ",").alias("top_3"), "weighted_risk_score")


def evidence_summary(evidence: DataFrame) -> DataFrame:
    rows = evidence.select(F.trim("wallet").alias("wallet"), F.trim("reason_code").alias("code")).filter(
        "wallet <> '' AND code <> ''")
    listed = F.transform("entries", lambda e: e["code"])
    risk = F.aggregate("entries", F.lit(0).cast("bigint"), lambda acc, e: acc + e["n"] * F.coalesce(
        lookup(P.EVIDENCE_RISK, e["code"]), F.lit(0)))
    return _ordered_counts(rows).select(
        "wallet", listed.alias("reason_codes"),
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["code"], e["n"]))).alias("reason_freq"),
        F.array_join(F.slice(listed, 1, 10), ",").alias("top_reasons"), risk.alias("reason_risk_score"))


def days_old(created_at: Column, as_of: int) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.floor((F.lit(as_of) - created_at) / DAY)), F.lit(0))


def default_reasons(reasons: DataFrame, scored_wallets: DataFrame, as_of: int,
                    weights: dict[str, int] = P.REASON_WEIGHTS) -> DataFrame:
    """Reasons plus CLEAN_HISTORY for every scored wallet without a negative code."""
    negative = F.coalesce(lookup(weights, F.col("reason_code")), F.lit(0)) < 0
    bad = reasons.filter(negative).select("wallet").distinct()
    rows = reasons.select("wallet", F.col("reason_code").alias("code"), "confidence", "tx_hash",
                          days_old(F.col("created_at"), as_of).alias("days_old"))
    marked = rows.join(bad.withColumn("_bad", F.lit(True)), "wallet", "left").filter(
        (F.col("code") != P.NO_RISK) | F.col("_bad").isNull()).drop("_bad")
    wallets = reasons.select("wallet").union(scored_wallets.select("wallet")).distinct()
    clean = wallets.join(bad, "wallet", "left_anti").select(
        "wallet", F.lit("CLEAN_HISTORY").alias("code"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("tx_hash"), F.lit(0).cast("bigint").alias("days_old"))
    return marked.unionByName(clean)


def dedupe_reasons(reasons: DataFrame, scores: DataFrame, low: int = -50,
                   high: int = 40) -> tuple[DataFrame, DataFrame]:
    """(reasons, scores): one row per (wallet, code), and the scores they lead to."""
    per_code = reasons.groupBy(F.trim("wallet").alias("wallet"), F.trim("reason_code").alias("reason_code")).agg(
        F.sum("weight").alias("weight"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    others = per_code.filter(F.col("reason_code") != P.NO_RISK).select("wallet").distinct()
    kept = per_code.filter(F.col("reason_code") != P.NO_RISK).unionByName(
        per_code.filter(F.col("reason_code") == P.NO_RISK).join(others, "wallet", "left_anti"))
    weight = F.when(F.col("weight") < 0, F.greatest(F.lit(low), F.col("weight"))).otherwise(
        F.least(F.lit(high), F.col("weight")))
    rows = kept.withColumn("weight", weight).join(scores.select("wallet"), "wallet", "left_semi")
    totals = rows.groupBy("wallet").agg(
        F.sum("weight").alias("_total"),
        F.array_join(F.array_sort(F.collect_list("reason_code")), ",").alias("reason_codes"))
    final = rnd(clamp(F.coalesce("_base", F.lit(50.0)) + F.col("_total")), 2)
    out = totals.join(scores.select("wallet", F.col("score").alias("_base")), "wallet").withColumn("score", final)
    return rows, out.select("wallet", "score", risk_level(F.col("score"), "rank_low_good").alias("risk_level"),
                            "reason_codes")


def effective_reasons(reasons: DataFrame, as_of: int, weights: dict[str, int] = P.REASON_WEIGHTS) -> DataFrame:
    code = F.col("reason_code")
    base = F.coalesce(lookup(weights, code), F.col("weight"), F.lit(0))
    signed = F.when(in_set(code, P.HIGH_RISK_CODES), -F.abs(base)).otherwise(base)
    old = F.lit(as_of) - F.col("created_at") > 90 * DAY
    default = F.when(code == "CLEAN_HISTORY", 0.7).when(code == "SCAM_CLUSTER_MEMBER", 0.9).otherwise(1.0)
    return reasons.select(
        "wallet", code.alias("code"), F.when(old, (signed / 2).cast("int")).otherwise(signed).alias("weight"),
        clamp(F.coalesce("confidence", default), 0.0, 1.0).alias("confidence"),
        days_old(F.col("created_at"), as_of).alias("days_old"))


def reason_weights(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """The weight table, with rows of ``overrides`` (code, weight) winning."""
    base = spark.range(1).select(F.explode(F.create_map(
        *[F.lit(x) for pair in P.REASON_WEIGHTS.items() for x in pair])).alias("code", "weight"))
    if overrides is None:
        return base
    return base.join(overrides.select("code", F.col("weight").alias("_w")), "code", "full").select(
        "code", F.coalesce("_w", "weight").cast("int").alias("weight"))


def explanations(reasons: DataFrame, templates: dict[str, str] = P.REASON_TEMPLATES) -> DataFrame:
    """Explanation texts by weight.  Input has one row per (wallet, code), as ``dedupe_reasons`` gives it."""
    w = Window.partitionBy("wallet")
    rows = reasons.withColumn("_n", F.count(F.lit(1)).over(w)).filter(
        (F.col("_n") == 1) | (F.col("reason_code") != P.NO_RISK))
    rank = F.row_number().over(w.orderBy(F.abs("weight").desc(), "reason_code"))
    text = F.coalesce(lookup(templates, F.col("reason_code")),
                      F.concat(F.lit("["), F.col("reason_code"), F.lit("]")))
    return rows.select("wallet", rank.alias("rank"), F.col("reason_code").alias("code"), text.alias("text"),
                       rnd(F.col("confidence"), 2).alias("confidence"))


def _in_order(value: Column, order: Column) -> Column:
    """Array of the non-null values of a (small) group in the given order."""
    entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.filter(F.transform(entries, lambda e: e["v"]), lambda v: v.isNotNull())


def reason_summary(rows: DataFrame, variant: str) -> DataFrame:
    """One sentence per wallet from ``explanations`` rows (wallet, rank, code, text, weight where needed)."""
    code, rank = F.col("code"), F.col("rank")
    if variant == "explanations":
        shown = F.regexp_replace("text", "^This wallet ", "Wallet ")
        g = rows.filter("rank <= 2").groupBy("wallet").agg(_in_order(shown, rank).alias("t"))
        second = F.concat(F.lower(F.substring(F.col("t")[1], 1, 1)), F.expr("substring(t[1], 2)"))
        text = F.when(F.size("t") == 1, F.col("t")[0]).otherwise(F.concat(F.col("t")[0], F.lit(" and "), second))
    elif variant == "phrases":
        g = rows.groupBy("wallet").agg(_in_order(lookup(P.NEGATIVE_PHRASES, code), rank).alias("n"),
                                       _in_order(lookup(P.POSITIVE_PHRASES, code), rank).alias("p"))
        sentence = lambda c: F.concat(F.lit("Wallet "), F.array_join(c, ", "), F.lit("."))
        text = (F.when(F.size("n") > 0, sentence("n")).when(F.size("p") > 0, sentence("p"))
                .otherwise("No significant activity detected."))
    elif variant == "codes":
        g = rows.groupBy("wallet").agg(_in_order(F.when(F.col("weight") < 0, code), rank).alias("n"),
                                       _in_order(F.when(F.col("weight") > 0, code), rank).alias("p"))
        first = lambda c: F.array_join(F.slice(c, 1, 3), ", ")
        text = (
            F.when(F.size("n") > 0, F.concat(F.lit("Wallet flagged for: "), first("n"), F.lit(". Trust score reduced.")))
            .when(F.size("p") > 0, F.concat(F.lit("Wallet shows positive signals: "), first("p"), F.lit(".")))
            .otherwise("No strong signals."))
    elif variant == "final":
        g = rows.groupBy("wallet").agg(
            _in_order(F.coalesce(lookup(P.FINAL_PHRASES, code), title_case(code)), rank).alias("t"))
        text = F.when(F.size("t") > 0, F.concat(F.array_join("t", ", "), F.lit("."))).otherwise(
            "No significant risk signals detected")
    else:
        raise ValueError(variant)
    return g.select("wallet", text.alias("summary"))


def badge_card(scores: DataFrame, reasons: DataFrame, templates: dict[str, str] = P.REASON_TEMPLATES) -> DataFrame:
    """Badge, risk text, top reasons and message of every scored wallet (risk is the stored level 0-3)."""
    top = newest_n(reasons.filter("reason_code IS NOT NULL"), ["wallet"],
                   [F.abs("weight").desc(), F.col("reason_code")], 3, rank="rank")
    top = top.filter(F.col("reason_code") != P.NO_RISK)
    code = F.col("reason_code")
    text = F.coalesce(lookup(templates, code), F.concat(F.lit("["), code, F.lit("]")))
    g = top.groupBy("wallet").agg(_in_order(code, F.col("rank")).alias("top_reasons"),
                                  _in_order(text, F.col("rank")).alias("texts"))
    s = scores.select("wallet", rnd(F.coalesce("score", F.lit(50.0)), 2).alias("score"),
                      F.coalesce(F.col("risk").cast("string"), F.lit("1")).alias("risk"))
    b = badge(F.col("score"), "four")
    df = s.join(g, "wallet", "left").withColumns({
        "badge": b["name"], "color": b["color"],
        "risk_level_text": F.coalesce(lookup(P.RISK_TEXT, F.col("risk")), F.lit("Unknown")),
        "top_reasons": F.coalesce("top_reasons", F.array().cast("array<string>")),
    })
    short = F.transform(F.slice("texts", 1, 2), lambda t: F.trim(F.replace(t, F.lit("This wallet "), F.lit(""))))
    plain = F.format_string("Score %s. Risk level: %s.", F.col("score").cast("string"), F.col("risk_level_text"))
    quiet = F.when(F.col("badge") == "Trusted", "No significant risk detected.").otherwise(plain)
    has = F.size("texts") > 0
    return df.select(
        "wallet", "score", "risk", "risk_level_text", "badge", "color", "top_reasons",
        F.when(has, F.col("texts")[0]).otherwise(quiet).alias("message"),
        F.when(has, F.concat(F.col("badge"), F.lit(" — "), F.array_join(short, " and "))).otherwise(quiet)
        .alias("summary"))


def label_scores(labels: DataFrame) -> DataFrame:
    pick = lambda i, default: F.coalesce(
        lookup({k: v[i] for k, v in P.LABEL_SCORES.items()}, F.trim("label")), F.lit(default))
    return labels.select("wallet", pick(0, 50).alias("score"), pick(1, 2).alias("risk"))


def replace_reasons(reasons: DataFrame, evidence: DataFrame, wallets: DataFrame, as_of: int,
                    weights: dict[str, int] = P.REASON_WEIGHTS) -> DataFrame:
    """Reasons of the given wallets rebuilt from evidence (first row per code); other wallets are untouched."""
    first = evidence.filter("trim(reason_code) <> ''").groupBy("wallet", F.trim("reason_code").alias("reason_code")).agg(
        F.min_by("tx_signature", F.struct(F.coalesce("timestamp", F.lit(0)), "tx_signature")).alias("tx_hash"))
    fresh = first.join(wallets.select("wallet").distinct(), "wallet", "left_semi").select(
        "wallet", "reason_code", F.coalesce(lookup(weights, F.col("reason_code")), F.lit(0)).alias("weight"),
        F.lit(1.0).alias("confidence"), "tx_hash", F.lit(as_of).cast("bigint").alias("created_at"))
    none = wallets.select("wallet").distinct().join(fresh, "wallet", "left_anti").select(
        "wallet", F.lit(P.NO_RISK).alias("reason_code"), F.lit(0).alias("weight"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("string").alias("tx_hash"), F.lit(as_of).cast("bigint").alias("created_at"))
    kept = reasons.select(*fresh.columns).join(wallets.select("wallet").distinct(), "wallet", "left_anti")
    return kept.unionByName(fresh).unionByName(none)
