"""Alerts with cooldown and the escalation state of each wallet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import DAY, lookup, rnd
from ledgerwise.functions.storage import cut_lineage


def shorten(c: Column, limit: int = 500) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 3), F.lit("...")))


def alerts(scores: DataFrame, flags: DataFrame, recent_alerts: DataFrame, as_of: int,
           cfg: P.AlertConfig = P.AlertConfig()) -> DataFrame:
    """New alerts: low scores and flags from medium upwards, unless the same one was raised in the cooldown."""
    low = scores.filter(F.col("score") < cfg.score_below).select(
        "wallet", F.lit("risk_score").alias("severity"),
        F.format_string("Trust score below threshold: %.1f < %.1f", F.col("score"), F.lit(cfg.score_below)).alias("reason"))
    raised = flags.select("wallet", F.explode("flags").alias("f")).filter(
        lookup(P.SEVERITY_RANK, F.col("f.severity")) >= P.SEVERITY_RANK["medium"]).select(
        "wallet", F.col("f.severity").alias("severity"), F.col("f.message").alias("reason"))
    rows = low.unionByName(raised).withColumn("reason", shorten(F.col("reason"), cfg.max_reason)).distinct()
    recent = recent_alerts.filter(F.col("created_at") >= as_of - cfg.cooldown_s).select("wallet", "severity", "reason")
    return rows.join(recent.distinct(), ["wallet", "severity", "reason"], "left_anti").withColumn(
        "created_at", F.lit(as_of).cast("bigint"))


def alert_type(severity: Column, reason: Column) -> Column:
    """Type of a stored alert from its text; any other alert counts under its own severity."""
    r, s = F.lower(F.coalesce(reason, F.lit(""))), F.lower(F.coalesce(severity, F.lit("")))
    return (
        F.when(r.contains("burst") | r.contains("transaction"), "burst_transactions")
        .when(r.contains("velocity"), "suspicious_velocity")
        .when(r.contains("fresh") | r.contains("high value"), "fresh_wallet_high_value")
        .when(r.contains("trust score") | (s == "risk_score"), "risk_score")
        .otherwise(F.concat(F.lit("other_"), s)))


def alert_context(observations: DataFrame, alert_rows: DataFrame,
                  cfg: P.EscalationConfig = P.EscalationConfig()) -> DataFrame:
    """Observations with the alerts of the two days before: their types, and how many fell in the last hour.

    Time is cut into buckets as wide as the look-back; an alert is placed in its own and
    the next bucket, so a wallet with very many rows is spread over its buckets.  An observation meets each type of its
    bucket once, whatever the types are, and reads the type's last alert so far from a growing frame; all that is
    grouped by (wallet, bucket), in one shuffle.
    """
    width = cfg.recent_s
    home = lambda c: F.floor(F.col(c) / width)
    obs = observations.select("wallet", "ts", "types", home("ts").alias("_bucket"))
    al = alert_rows.select(
        "wallet", F.col("created_at").alias("ts"), F.explode(F.array(home("created_at"), home("created_at") + 1)).alias("_bucket"),
        alert_type(F.col("severity"), F.col("reason")).alias("_type"))
    al = al.groupBy("wallet", "_bucket", "ts", "_type").agg(F.count(F.lit(1)).alias("_n"))
    rows = obs.join(al.select("wallet", "_bucket", "_type").distinct(), ["wallet", "_bucket"], "left").unionByName(
        al.withColumn("_at", F.col("ts")), allowMissingColumns=True)
    in_bucket = Window.partitionBy("wallet", "_bucket").orderBy("ts")
    of_type = Window.partitionBy("wallet", "_bucket", "_type").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.max("_at").over(of_type)).withColumn(
        "hour_count", F.coalesce(F.sum("_n").over(in_bucket.rangeBetween(-cfg.cluster_s, 0)), F.lit(0)))
    recent = F.when(F.col("_last") >= F.col("ts") - cfg.recent_s, F.col("_type"))
    return rows.filter("types IS NOT NULL").groupBy("wallet", "_bucket", "ts").agg(
        F.any_value("types").alias("types"), F.max("hour_count").alias("hour_count"),
        F.collect_set(recent).alias("recent_types")).drop("_bucket")


def _max_before(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds the greatest ``value`` among the wallet's earlier rows, bucket by bucket."""
    keyed = df.withColumn("_v", value)
    inner = Window.partitionBy("wallet", "_bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("wallet").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = keyed.groupBy("wallet", "_bucket").agg(F.max("_v").alias("_m")).select(
        "wallet", "_bucket", F.max("_m").over(outer).alias("_c"))
    return keyed.withColumn("_i", F.max("_v").over(inner)).join(per, ["wallet", "_bucket"]).withColumn(
        name, F.greatest("_i", "_c")).drop("_v", "_i", "_c")


def _compose(steps: Column) -> Column:
    """One clamp x -> min(hi, max(lo, x + a)) equal to applying the ordered steps one after another."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    bound = lambda y, s: F.least(s["hi"], F.greatest(s["lo"], y + s["a"]))
    return F.aggregate(steps, start, lambda f, s: F.struct(
        (f["a"] + s["a"]).alias("a"), bound(f["lo"], s).alias("lo"), bound(f["hi"], s).alias("hi")))


def escalation_state(observations: DataFrame, alert_rows: DataFrame, previous: DataFrame | None = None,
                     cfg: P.EscalationConfig = P.EscalationConfig()) -> DataFrame:
    """Escalation state after all observations (wallet, ts, types: one row per wallet and time).

    Every step changes the score by a clamp x -> min(hi, max(lo, x + a)).  Clamps compose
    to clamps, so each (wallet, hour) is folded on its own, then the hours of a month, the months of five years and
    these: a list has at most 3600, 720 and 61 entries, and no task has to walk through a whole wallet.
    """
    df = cut_lineage(alert_context(observations, alert_rows, cfg))
    if previous is None:
        df = df.withColumns({"_x0": F.lit(0.0), "_alert0": F.lit(None).cast("bigint"), "_clean0": F.lit(None).cast("bigint")})
    else:
        df = df.join(previous.select("wallet", F.col("score").alias("_x0"), F.col("last_alert_ts").alias("_alert0"),
                                     F.col("last_clean_ts").alias("_clean0")), "wallet", "left").withColumn(
            "_x0", F.coalesce("_x0", F.lit(0.0)))
    anomalous = F.size("types") > 0
    df = df.withColumns({"_bucket": F.floor(F.col("ts") / DAY), "quiet": ~anomalous & (F.size("recent_types") == 0)})
    start = df.groupBy("wallet").agg(F.min("ts").alias("_start"))
    df = _max_before(df, "_clean", F.when(F.col("quiet"), F.col("ts"))).join(start, "wallet")
    df = df.withColumn("_clean", F.coalesce("_clean", "_clean0", "_start"))
    idle = F.col("ts") - F.col("_clean")
    df = df.withColumn("reset", F.col("quiet") & (idle >= cfg.clean_reset_s))
    df = cut_lineage(df)  # each pass reads its input twice
    df = _max_before(df, "_reset", F.when(F.col("reset"), F.col("ts")))
    df = _max_before(df, "_alert", F.when(anomalous, F.col("ts")))
    alerted = F.when(F.col("_reset").isNull(), F.coalesce("_alert", "_alert0")).otherwise(
        F.when(F.col("_alert") > F.col("_reset"), F.col("_alert")))
    union = F.array_union("types", "recent_types")
    repeated = F.size(F.array_intersect("types", "recent_types"))
    points = (
        F.size("types") * cfg.per_flag + repeated * cfg.repeated
        + F.when(F.size(union) >= 2, cfg.multiple_types).otherwise(0.0)
        + F.when(F.col("hour_count") >= cfg.cluster_alerts, cfg.time_cluster).otherwise(0.0))
    cooled = (idle >= cfg.clean_reduce_s) & ~anomalous
    inf = float("inf")
    step = lambda a, lo, hi: F.struct(a.alias("a"), lo.alias("lo"), hi.alias("hi"))
    low = F.lit(-inf)
    decay = F.col("quiet") & (F.col("ts") - alerted >= cfg.clean_reduce_s)
    clamp_step = (
        F.when(F.col("reset"), step(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
        .when(F.coalesce(decay, F.lit(False)), step(F.lit(-cfg.decay), F.lit(0.0), F.lit(inf)))
        .when(F.col("quiet"), step(F.lit(0.0), low, F.lit(inf)))
        .when(cooled, step(points - cfg.decay, F.least(points, F.lit(cfg.cap)), F.lit(cfg.cap)))
        .otherwise(step(points, low, F.lit(cfg.cap))))
    df = cut_lineage(df.withColumn("step", clamp_step))

    def fold(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("step").alias("s"))))
        return rows.groupBy(*keys).agg(ordered.alias("_l")).select(
            *keys, _compose(F.transform("_l", lambda e: e["s"])).alias("step"))

    hours = fold(df.withColumn("_hour", F.floor(F.col("ts") / 3600)), ["wallet", "_hour"], "ts")
    months = fold(hours.withColumn("_month", F.floor(F.col("_hour") / 720)), ["wallet", "_month"], "_hour")
    eras = fold(months.withColumn("_era", F.floor(F.col("_month") / 61)), ["wallet", "_era"], "_month")
    total = fold(eras, ["wallet"], "_era")
    last = F.max_by(F.struct(
        F.when(repeated > 0, "repeated").alias("r1"), F.when(F.size(union) >= 2, "multiple_types").alias("r2"),
        F.when(F.col("hour_count") >= cfg.cluster_alerts, "time_cluster").alias("r3")), "ts")
    ends = df.groupBy("wallet").agg(
        F.max(F.when(F.col("quiet"), F.col("ts"))).alias("_q"), F.max(F.when(F.col("reset"), F.col("ts"))).alias("_r"),
        F.max(F.when(anomalous, F.col("ts"))).alias("_a"), F.min("_clean0").alias("_clean0"), F.min("_alert0").alias("_alert0"),
        F.min("ts").alias("_start"), F.max("_x0").alias("_x0"), last.alias("_why"))
    out = ends.join(total, "wallet")
    score = rnd(F.least(F.col("step.hi"), F.greatest(F.col("step.lo"), F.col("_x0") + F.col("step.a"))), 2)
    stage = F.when(F.col("score") <= cfg.normal_max, "normal").when(F.col("score") <= cfg.warning_max, "warning").otherwise(
        "critical")
    return out.withColumn("score", score).withColumn("stage", stage).select(
        "wallet", "stage", "score", F.when(F.col("stage") == "warning", "watchlist").otherwise(F.col("stage")).alias("tier"),
        F.when(F.col("_r").isNull(), F.coalesce("_a", "_alert0")).otherwise(F.when(F.col("_a") > F.col("_r"), F.col("_a")))
        .alias("last_alert_ts"),
        F.coalesce("_q", "_clean0", "_start").alias("last_clean_ts"),
        F.array_compact(F.array("_why.r1", "_why.r2", "_why.r3")).alias("reasons"))
