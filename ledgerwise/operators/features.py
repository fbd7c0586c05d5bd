"""Per-wallet activity features and anomaly flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import (
    DAY, LAMPORTS_PER_SOL, assemble, both_ends, clamp, lookup, near_in_time, newest_n, ratio, rnd,
)
from ledgerwise.functions.storage import by_wallet, cut_lineage

TIME_BUCKET = 3_600
SLOT_BUCKET = 10_000


def wallet_pairs(transfers: DataFrame) -> DataFrame:
    """Transfers pre-aggregated per (wallet, counterparty): a hot wallet shrinks map-side to its partners."""
    ends = both_ends(transfers, "amount_lamports", "ts")
    return ends.groupBy("wallet", "counterparty").agg(
        F.count(F.lit(1)).alias("tx_count"),
        F.count_if("is_sender").alias("tx_out"),
        F.count_if(~F.col("is_sender")).alias("tx_in"),
        F.coalesce(F.sum("amount_lamports"), F.lit(0)).alias("lamports"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("ts").alias("ts_count"),
    )


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """Pair aggregates of several batches merged into one row per (wallet, counterparty)."""
    sums = [F.sum(c).alias(c) for c in ("tx_count", "tx_out", "tx_in", "lamports", "ts_count")]
    return pairs.groupBy("wallet", "counterparty").agg(
        *sums, F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def wallet_features(transfers: DataFrame, min_span_s: float = 1.0) -> DataFrame:
    return features_from_pairs(wallet_pairs(transfers), min_span_s)


def features_from_pairs(pairs: DataFrame, min_span_s: float = 1.0) -> DataFrame:
    per_wallet = pairs.groupBy("wallet").agg(
        F.sum("tx_count").alias("tx_count"),
        F.count_if(F.col("counterparty") != F.col("wallet")).alias("unique_counterparties"),
        F.sum("lamports").alias("volume_lamports"),
        F.min("first_ts").alias("_first"), F.max("last_ts").alias("_last"), F.sum("ts_count").alias("_n_ts"),
    )
    gap = F.col("_last") - F.col("_first")
    span = F.when((F.col("_n_ts") >= 2) & (gap > 0), F.greatest(gap.cast("double"), F.lit(float(min_span_s))))
    sol = F.col("volume_lamports") / F.lit(float(LAMPORTS_PER_SOL))
    days = F.col("span_days")
    return (
        per_wallet.withColumn("span_s", span).withColumn("span_days", F.col("span_s") / float(DAY))
        .select(
            "wallet", "tx_count",
            (F.col("tx_count") / days).alias("tx_frequency"),
            rnd(F.col("volume_lamports").cast("double") / F.col("tx_count"), 2).alias("avg_lamports"),
            rnd(sol / F.col("tx_count"), 9).alias("avg_sol"),
            "unique_counterparties",
            (F.col("volume_lamports").cast("double") / days).alias("velocity_lamports"),
            (sol / days).alias("velocity_sol"),
            "volume_lamports", rnd(sol, 9).alias("volume_sol"), "span_days", "span_s",
        )
    )


def tx_frequency(transfers: DataFrame) -> DataFrame:
    ends = both_ends(transfers, self_once=False)
    return ends.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("tx_count"),
        F.count_if("is_sender").alias("as_sender_count"),
        F.count_if(~F.col("is_sender")).alias("as_receiver_count"),
    )


def _graded(value: Column, limits: tuple[float, float, float], when: Column, kind: str, rule: str,
            message: str, *args: Column) -> Column:
    """Flag struct of the highest limit reached, null when none is."""
    critical, high, medium = limits
    severity = F.when(value >= critical, "critical").when(value >= high, "high").when(value >= medium, "medium")
    limit = F.when(value >= critical, F.lit(critical)).when(value >= high, F.lit(high)).otherwise(F.lit(medium))
    return F.when(
        when & (value >= medium),
        F.struct(
            F.lit(kind).alias("type"), severity.alias("severity"),
            F.format_string(message, *args, limit).alias("message"), F.lit(rule).alias("rule_name"),
            F.create_map(F.lit("value"), value.cast("double"), F.lit("threshold"), limit.cast("double"))
            .alias("details"),
        ),
    )


def anomaly_flags(features: DataFrame, cfg: P.AnomalyConfig = P.AnomalyConfig()) -> DataFrame:
    freq, velocity = F.col("tx_frequency"), F.col("velocity_sol")
    fresh_value = F.greatest("volume_sol", "avg_sol")
    flags = F.array(
        _graded(freq, cfg.burst_per_day, F.col("tx_count") >= 2, "burst_transactions",
                "burst_tx_frequency_per_day", "Burst activity: %.1f transactions per day (threshold: %.1f)", freq),
        _graded(velocity, cfg.velocity_sol, F.lit(True), "suspicious_velocity",
                "suspicious_velocity_sol_per_day", "Suspicious velocity: %.2f SOL/day (threshold: %.1f SOL/day)",
                velocity),
        _graded(fresh_value, cfg.fresh_sol, F.col("tx_count").between(1, cfg.fresh_max_tx),
                "fresh_wallet_high_value", "fresh_wallet_high_value",
                "Fresh wallet (%d txs) moving high value: %.2f SOL (threshold: %.1f SOL)",
                F.col("tx_count"), fresh_value),
    )
    return features.select("wallet", F.array_compact(flags).alias("flags"))


def anomaly_summary(flags: DataFrame) -> DataFrame:
    rank = F.array_max(F.transform("flags", lambda f: lookup(P.SEVERITY_RANK, f["severity"])))
    names = {str(v): k for k, v in P.SEVERITY_RANK.items()}
    return flags.select(
        "wallet", (F.size("flags") > 0).alias("is_anomalous"),
        lookup(names, rank.cast("string")).alias("max_severity"),
    )


def base_trust_score(flags: DataFrame) -> DataFrame:
    penalty = F.aggregate(
        "flags", F.lit(0.0),
        lambda acc, f: acc + F.coalesce(lookup(P.SEVERITY_PENALTY, f["severity"]), F.lit(0.0)),
    )
    return flags.select("wallet", clamp(100.0 - penalty).alias("score"))


def wallet_records(transfers: DataFrame) -> DataFrame:
    """One row per (wallet, transfer) with the other end as destination."""
    return both_ends(transfers, "signature", "ts", "slot", "amount_lamports", "program_id")


def _longest_run(slots: DataFrame, gap: int) -> DataFrame:
    """Most rows of a wallet in a run of slots at most ``gap`` apart.

    Runs are built inside a slot bucket; only those near an edge, at most two per bucket, meet per wallet.
    """
    bucket = F.floor(F.col("slot") / SLOT_BUCKET)
    counts = slots.filter("slot IS NOT NULL").groupBy("wallet", "slot").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "_bucket", bucket)

    def runs(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(first)
        fresh = F.coalesce((F.col(first) - F.lag(last).over(w) > gap).cast("int"), F.lit(0))
        marked = df.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w))
        return marked.groupBy(*keys, "_run").agg(F.min(first).alias("_from"), F.max(last).alias("_to"), F.sum("n").alias("n"))

    inner = runs(counts, ["wallet", "_bucket"], "slot", "slot")
    start = F.col("_bucket") * SLOT_BUCKET
    edge = (F.col("_from") - start < gap) | (start + SLOT_BUCKET - F.col("_to") <= gap)
    joined = runs(inner.filter(edge).select("wallet", "_from", "_to", "n"), ["wallet"], "_from", "_to")
    return inner.filter(~edge).select("wallet", "n").unionByName(joined.select("wallet", "n")).groupBy("wallet").agg(
        F.max("n").alias("tx_chain_length_estimate"))


def _flow_parts(rows: DataFrame, hot: bool) -> list[DataFrame]:
    """Totals, rapid transfers and longest runs.  Hot wallets are cut into time and slot buckets, others are ordered as a whole."""
    pairs = rows.groupBy("wallet", "counterparty").agg(
        F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_ts"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    span = F.max("last") - F.min("first")
    timed = F.col("n_ts") > 0
    base = pairs.groupBy("wallet").agg(
        F.sum("n").alias("total_tx"),
        F.count("counterparty").alias("unique_destinations"),
        rnd(F.coalesce(ratio(span, F.sum("n_ts") - 1), F.lit(0.0)), 2).alias("avg_tx_interval"),
        rnd(F.coalesce(
            100.0 * ratio(
                F.count(F.when(timed, F.col("counterparty"))),
                F.sum(F.when(F.col("counterparty").isNotNull(), F.col("n_ts"))),
            ), F.lit(0.0)), 2).alias("percent_to_new_wallets"),
    )
    times = rows.filter("ts IS NOT NULL").select("wallet", "ts")
    if hot:
        near = near_in_time(times, "wallet", "ts", 30, 30, TIME_BUCKET, "_rapid")
        runs = _longest_run(rows.select("wallet", "slot"), 2)
    else:
        others = F.count(F.lit(1)).over(Window.partitionBy("wallet").orderBy("ts").rangeBetween(-30, 30))
        near = times.withColumn("_rapid", others > 1)
        w = Window.partitionBy("wallet").orderBy("slot")
        fresh = F.coalesce((F.col("slot") - F.lag("slot").over(w) > 2).cast("int"), F.lit(0))
        runs = rows.filter("slot IS NOT NULL").select("wallet", "slot").withColumn("_fresh", fresh).withColumn(
            "_run", F.sum("_fresh").over(w)).groupBy("wallet", "_run").agg(F.count(F.lit(1)).alias("n")).groupBy("wallet").agg(
            F.max("n").alias("tx_chain_length_estimate"))
    return [base, near.groupBy("wallet").agg(F.count_if("_rapid").alias("rapid_tx_count")), runs]


def flow_features(transfers: DataFrame, n: int | None = None, split: list[tuple[DataFrame, bool]] | None = None) -> DataFrame:
    """Flow features over all transfers of a wallet, or over its newest ``n``.  ``split``: the records, dealt out by ``by_wallet``."""
    if split is None:
        recent = wallet_records(transfers)
        if n is not None:
            recent = cut_lineage(newest_n(
                recent, ["wallet"], [F.coalesce("ts", F.lit(0)).desc(), F.col("signature").desc()], n))
        with by_wallet(recent.select("wallet", "counterparty", "ts", "slot")) as split:
            return flow_features(transfers, n, split)
    # each part is written before the next is computed, so only one holds shuffle files at a time
    base, rapid, runs = (reduce(DataFrame.unionByName, map(cut_lineage, same)) for same in zip(*[_flow_parts(*rows) for rows in split]))
    return assemble(base, rapid, runs).fillna(
        0, ["rapid_tx_count", "tx_chain_length_estimate"]).select(
        "wallet", "total_tx", "unique_destinations", "rapid_tx_count", "avg_tx_interval", "percent_to_new_wallets",
        "tx_chain_length_estimate")


def transfer_destination(tx_raw: DataFrame, wallet_col: str = "wallet") -> DataFrame:
    """Destination of the wallet's first transfer instruction, else the other of the first two account keys."""
    w = F.col(wallet_col)
    own = F.get(F.filter("instructions", lambda i: (i["type"] == "transfer") & (i["source"] == w)), F.lit(0))
    first, second = F.get("account_keys", F.lit(0)), F.get("account_keys", F.lit(1))
    other = F.when(first == w, second).otherwise(first)
    return tx_raw.select("signature", w.alias("wallet"), F.coalesce(own["destination"], other).alias("to"))


def tx_failure_features(transfers: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("err").isNotNull() & ~F.trim("err").isin("", "None"))
    out = transfers.groupBy("wallet").agg(F.count(F.lit(1)).alias("total_tx"), failed.alias("failed_tx"))
    return out.withColumn("failure_ratio", rnd(F.col("failed_tx").cast("double") / F.col("total_tx"), 3))
