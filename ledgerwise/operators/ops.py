"""Usage, cost, stage health and data-quality aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions.common import DAY, assemble, newest_n, ratio, rnd, utc_date

HOUR = 3_600


def usage_hourly(usage_events: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Counts and mean latency per (api_key, endpoint, hour); ``previous`` rows of the same shape are merged in."""
    ok = F.col("status") < 400
    part = usage_events.groupBy("api_key", "endpoint", (F.floor(F.col("ts") / HOUR) * HOUR).alias("hour")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("errors"),
        F.sum(F.col("response_ms").cast("decimal(28,6)")).cast("double").alias("_ms"))
    rows = part
    if previous is not None:
        rows = part.unionByName(previous.select(
            "api_key", "endpoint", "hour", "requests", "success", "errors",
            (F.col("avg_ms") * F.col("requests")).alias("_ms")))
        rows = rows.groupBy("api_key", "endpoint", "hour").agg(
            *[F.sum(c).alias(c) for c in ("requests", "success", "errors")],
            F.sum(F.col("_ms").cast("decimal(28,6)")).cast("double").alias("_ms"))
    return rows.withColumn("avg_ms", F.col("_ms") / F.col("requests")).drop("_ms")


def month_bounds(as_of: int) -> tuple[Column, Column]:
    """First second of the UTC month of ``as_of`` and of the next one."""
    first = F.trunc(utc_date(F.lit(as_of)), "month")
    seconds = lambda d: F.date_diff(d, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY
    return seconds(first), seconds(F.add_months(first, 1))


def _weighted_ms() -> Column:
    return ratio(F.sum((F.col("avg_ms") * F.col("requests")).cast("decimal(28,6)")), F.sum("requests"))


def usage_summary(hourly: DataFrame, keys: DataFrame, as_of: int) -> DataFrame:
    """Use of the current month per user.  keys: api_key, user, quota_limit."""
    low, high = month_bounds(as_of)
    rows = hourly.filter((F.col("hour") >= low) & (F.col("hour") < high)).join(keys.select("api_key", "user"), "api_key")
    g = rows.groupBy("user").agg(
        F.sum("requests").alias("used"), F.sum("success").alias("success"), F.sum("errors").alias("errors"),
        rnd(_weighted_ms(), 1).alias("avg_ms"))
    users = keys.groupBy("user").agg(F.max("quota_limit").alias("limit"))
    df = assemble(users, g, key="user").fillna(0, ["used", "success", "errors", "avg_ms"])
    pct = F.when(F.col("limit") > 0, rnd(F.col("used") * 100.0 / F.col("limit"), 1)).otherwise(0.0)
    return df.withColumn("pct", pct)


def _recent(hourly: DataFrame, keys: DataFrame, as_of: int, days: int) -> DataFrame:
    return hourly.filter(F.col("hour") >= as_of - days * DAY).join(keys.select("api_key", "user"), "api_key").withColumn(
        "endpoint", F.coalesce("endpoint", F.lit("unknown")))


def _totals() -> list[Column]:
    return [F.sum("requests").alias("requests"), F.sum("success").alias("success"), F.sum("errors").alias("errors")]


def usage_daily(hourly: DataFrame, keys: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    day = utc_date(F.col("hour")).cast("string").alias("date")
    return _recent(hourly, keys, as_of, days).groupBy("user", day).agg(*_totals())


def usage_by_endpoint(hourly: DataFrame, keys: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    return _recent(hourly, keys, as_of, days).groupBy("user", "endpoint").agg(
        *_totals(), rnd(_weighted_ms(), 1).alias("avg_ms"))


def usage_by_status(hourly: DataFrame, keys: DataFrame, as_of: int, days: int = 30) -> DataFrame:
    """Two rows per user: success and error counts."""
    g = _recent(hourly, keys, as_of, days).groupBy("user").agg(*_totals())
    return g.unpivot("user", ["success", "errors"], "status", "count")


def api_cost(usage: DataFrame, as_of: int, daily_limit: float, price: float = 1e-5,
             n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(today's totals, most expensive wallets).  usage: wallet, calls, ts; today is the UTC day of ``as_of``."""
    start = as_of // DAY * DAY
    today = usage.filter((F.col("ts") >= start) & (F.col("ts") < start + DAY))
    calls = F.coalesce(F.sum("calls"), F.lit(0))
    total = today.agg(calls.alias("calls")).withColumn("cost", F.col("calls") * price).withColumns(
        {"monthly": F.col("cost") * 30, "over_budget": F.col("cost") > daily_limit})
    top = today.groupBy("wallet").agg(F.sum("calls").alias("calls")).withColumn("cost", F.col("calls") * price)
    return total, top.orderBy(F.desc("calls"), "wallet").limit(n)


def stage_health(stage_log: DataFrame, as_of: int, n_errors: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(per stage, errors) of the last 24 hours: all errors, or the newest ``n_errors``."""
    recent = stage_log.filter((F.col("ts") >= as_of - DAY) & (F.col("ts") <= as_of))
    ok, err = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "error")
    per = recent.groupBy("stage").agg(
        ok.alias("ok"), err.alias("error"), rnd(ratio(ok, F.count(F.lit(1))), 4).alias("success_rate"),
        rnd(ratio(F.sum(F.col("latency_ms").cast("decimal(28,6)")), F.count("latency_ms")), 2).alias("avg_latency_ms"))
    errors = recent.filter("status = 'error'")
    if n_errors is not None:
        errors = errors.orderBy(F.desc("ts"), "message").limit(n_errors)
    errors = errors.select("ts", "stage", "message", "wallet")
    return per, errors


def run_summary(pipeline_runs: DataFrame) -> DataFrame:
    """pipeline_runs: run_id, started_at, success, wallets."""
    latest = F.max_by(F.struct("run_id", "success"), F.struct("started_at", "run_id"))
    return pipeline_runs.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("success")).alias("failures"), F.sum("wallets").alias("wallets"),
        latest.alias("_l")).select("runs", "failures", "wallets", F.col("_l.run_id").alias("latest_run"),
                                   F.col("_l.success").alias("latest_success"))


def trust_stats(scores: DataFrame, scam: DataFrame, as_of: int) -> DataFrame:
    """scam: wallet, detected_at.  One row of totals."""
    start = as_of // DAY * DAY
    new = scam.agg(F.count_if(F.col("detected_at") >= start).alias("n")).scalar()
    return scores.agg(
        rnd(ratio(F.sum(F.col("score").cast("decimal(28,6)")), F.count("score")), 2).alias("avg_score"),
        F.count("score").alias("scored"), F.count_if(F.col("score") < 40).alias("high_risk"),
    ).withColumn("new_scam_today", new)


def ops_alerts(cost: DataFrame, runs: DataFrame, queue: DataFrame, daily_limit: float, queue_limit: int) -> DataFrame:
    """Rows (type, message, severity) for cost, the last run and the length of the review queue."""
    msg = lambda kind, text, sev: [F.lit(kind).alias("type"), text.alias("message"), F.lit(sev).alias("severity")]
    a = cost.filter(F.col("cost") > daily_limit).select(*msg(
        "helius_cost", F.format_string("Helius cost $%.2f exceeds limit $%s", F.col("cost"), F.lit(str(daily_limit))), "high"))
    b = run_summary(runs).filter("NOT latest_success").select(*msg("pipeline_failed", F.lit("Last pipeline run failed"), "high"))
    c = queue.filter("status = 'pending'").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > queue_limit).select(*msg(
        "review_queue", F.format_string("Review queue (%d) exceeds threshold (%d)", F.col("n"), F.lit(queue_limit)), "medium"))
    return a.unionByName(b).unionByName(c)


def integrity_checks(transfers: DataFrame, scores: DataFrame, reasons: DataFrame, history: DataFrame, members: DataFrame,
                     clusters: DataFrame, as_of: int) -> DataFrame:
    """One row per check: name, ok, violations.

    scores: wallet, score; reasons: wallet, reason_code, tx_hash, tx_link, weight; history: wallet, snapshot_at.
    """
    one = lambda name, df: df.select(F.lit(name).alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").alias("violations"))
    tally = lambda name, df, cond: one(name, df.agg(F.count_if(cond).alias("n")))
    blank = F.col("wallet").isNull() | (F.trim("wallet") == "")
    repeats = lambda df, keys: df.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n"))
    missing = lambda a, b: a.select("wallet").distinct().join(b.select("wallet"), "wallet", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    empty = clusters.select("cluster_id").join(members.select("cluster_id"), "cluster_id", "left_anti")
    checks = [
        tally("null_wallets_transfers", transfers, blank), tally("null_wallets_scores", scores, blank),
        tally("null_wallets_reasons", reasons, blank), one("duplicate_scores", repeats(scores, ["wallet"])),
        tally("timestamp_range", history, (F.col("snapshot_at") < 0) | (F.col("snapshot_at") > as_of)),
        one("empty_clusters", empty.agg(F.count(F.lit(1)).alias("n"))),
        tally("score_range", scores, (F.col("score") < 0) | (F.col("score") > 100)),
        one("duplicate_reasons", repeats(reasons, ["wallet", "reason_code", "tx_hash"])),
        one("reasons_without_score", missing(reasons, scores)), one("scores_without_reasons", missing(scores, reasons)),
        tally("bad_links", reasons, F.col("tx_link").isNotNull() & ~F.col("tx_link").startswith("https://")),
        one("has_positives", reasons.agg((F.count_if(F.col("weight") > 0) == 0).cast("bigint").alias("n"))),
    ]
    return reduce(DataFrame.unionByName, checks)


def score_reconciliation(left: DataFrame, right: DataFrame, tolerance: float = 0.0) -> DataFrame:
    df = left.select("wallet", F.col("score").alias("l")).join(right.select("wallet", F.col("score").alias("r")), "wallet", "full")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    same = both & (F.abs(F.col("l") - F.col("r")) <= tolerance)
    g = df.agg(F.count_if(same).alias("matches"), F.count_if(both & ~same).alias("mismatches"), F.count_if(~both).alias("missing"))
    total = F.col("matches") + F.col("mismatches") + F.col("missing")
    return g.withColumn("rate", rnd(F.coalesce(ratio(F.col("matches"), total), F.lit(0.0)), 4))
