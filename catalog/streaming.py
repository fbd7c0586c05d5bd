"""Streaming queries: the event table read as a file stream."""

import uuid

from pyspark.sql import functions as F

from catalog.features import _ROUND, _shown
from catalog.reasons import _DYN, _TWP, _conf_sql, day_codes, priors, sql_set
from catalog.registry import ORACLE, query
from catalog.reports import proposed, receivers
from catalog.timeseries import observations
from catalog.views import DAY, SQL_VIEWS, Views
from ledgerwise import params as P
from ledgerwise.functions.storage import cut_lineage, shared_dir
from ledgerwise.operators import scoring as C
from ledgerwise.operators.reports import check_transfers
from ledgerwise.streaming import native as N
from ledgerwise.streaming import stateful as S


class StreamViews(Views):
    """The canonical views over the event table read as a stream."""

    def table(self, name):
        if name != "events":
            return super().table(name)
        schema = self.spark.read.parquet(f"{self.dir}/events.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.dir}/events.parquet*")

    @property
    def ev(self):
        return self.raw_events()

    @property
    def transfers(self):
        return self.event_transfers()


def streamed(v) -> StreamViews:
    return StreamViews(v.spark, v.dir)


def transfers(v):
    return N.with_event_time(streamed(v).transfers)


@query("t01_stream_transfers", "SELECT signature, sender, receiver, amount_lamports, ts FROM transfers")
def _(v):
    return N.run_to_files(transfers(v).select("signature", "sender", "receiver", "amount_lamports", "ts")).drop("batch_id")


@query("t02_stream_dedupe", "SELECT wallet, signature, ts FROM transfers")
def _(v):
    twice = transfers(v).union(transfers(v))
    return N.run_to_files(N.stream_dedupe(twice, "40 days").select("wallet", "signature", "ts")).drop("batch_id")


@query("t03_stream_debounce", """SELECT wallet, min(ts) AS session_start, max(ts) + 600 AS session_end, count(*) AS n FROM (
    SELECT *, sum(brk) OVER (PARTITION BY wallet ORDER BY ts, signature) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY wallet ORDER BY ts, signature) <= 600 THEN 0 ELSE 1 END AS brk FROM transfers))
    GROUP BY wallet, run HAVING max(ts) + 600 <= (SELECT max(ts) FROM transfers) - 60""")
def _(v):
    return N.run_to_files(N.stream_debounce(transfers(v), "10 minutes", "1 minute")).drop("batch_id")


@query("t04_stream_features", _ROUND.format(f="features"))
def _(v):
    root = f"{shared_dir(v.spark)}/features-{uuid.uuid4().hex}"
    N.stream_features(transfers(v), f"{root}/history", f"{root}/sink", f"{root}/checkpoint").awaitTermination()
    rows = v.spark.read.parquet(f"{root}/sink").withColumnRenamed("batch", "batch_id").drop("flags")
    return _shown(N.newest_version(rows, ["wallet"]))


REPLAY_FILES = 8


def replayed(v, rows, schema, late_s=2 * DAY):
    """The rows as a file stream of four micro-batches: cut by time, every tenth row a batch late (up to ``late_s``).

    A last batch with a row far in the future lets the watermark pass all others; the watermark never passes that one.
    """
    path = f"{shared_dir(v.spark)}/replay-{uuid.uuid4().hex}"
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    width = (span.hi - span.lo) // 4 + 1
    late = F.when(F.pmod(F.xxhash64(*rows.columns), F.lit(10)) == 0, F.lit(late_s)).otherwise(F.lit(0))
    part = F.least(F.lit(3), F.floor((F.col("ts") + late - span.lo) / width))
    cut = cut_lineage(rows.withColumn("part", part))
    for k in range(4):  # one micro-batch has as many files as its step wrote
        cut.filter(F.col("part") == k).drop("part").repartition(REPLAY_FILES).write.mode("append").parquet(path)
    v.spark.range(REPLAY_FILES).select(*[
        F.lit(span.hi + 1000 * DAY).alias(c) if c == "ts" else F.lit("~").alias(c) for c in rows.columns
    ]).repartition(REPLAY_FILES).write.mode("append").parquet(path)
    return v.spark.readStream.schema(schema).option("maxFilesPerTrigger", REPLAY_FILES).parquet(path)


SQL_VIEWS["t_pen"] = _DYN.format(trig=sql_set(P.SCAM_TRIGGERS), twp=_TWP, conf=_conf_sql("1", "1", "0", "0", "0"), r="fs_codes", dist="1", extra="")
SQL_VIEWS["t_inputs"] = """SELECT wallet, coalesce(score, 50.0) AS score, coalesce(penalty, 0) - trunc(coalesce(posterior, 0.05) * 100) AS change
    FROM (SELECT wallet FROM latest_scores UNION SELECT wallet FROM fs_codes) LEFT JOIN latest_scores USING (wallet) LEFT JOIN t_pen USING (wallet)
    LEFT JOIN posterior_tab USING (wallet)"""
SQL_VIEWS["t_start"] = """SELECT e.wallet, min(e.ts) AS ts, any_value(coalesce(score, 50.0)) AS score, any_value(coalesce(change, -5.0)) AS change
    FROM ends e LEFT JOIN t_inputs USING (wallet) GROUP BY 1"""
SQL_VIEWS["t_walk"] = """SELECT wallet, ts, change, greatest(0, least(100, trunc(score) + change)) AS now FROM t_start UNION ALL
    SELECT w.wallet, (SELECT min(e.ts) FROM ends e WHERE e.wallet = w.wallet AND e.ts >= w.ts + 300), change, greatest(0, least(100, trunc(now) + change)) FROM t_walk w
    WHERE EXISTS (SELECT 1 FROM ends e WHERE e.wallet = w.wallet AND e.ts >= w.ts + 300)"""


@query("t05_stream_risk_update", "SELECT wallet, ts, CAST(trunc(now) AS INTEGER) AS new_score FROM t_walk")
def _(v):
    S.use_rocksdb(v.spark)
    w = C.forced_weight(F.col("code"), F.coalesce(C.lookup(P.REASON_WEIGHTS, F.col("code")), F.lit(0)))
    reasons = day_codes(v).groupBy("wallet", "code").agg(F.min("days_old").alias("days_old")).withColumn("weight", w)
    inputs = S.risk_inputs(v.latest_scores, reasons, priors(v))
    rows = v.transfers.select("sender", "receiver", "ts")
    stream = replayed(v, rows, "sender string, receiver string, ts bigint")
    return N.run_to_files(S.stream_risk_update(stream, inputs, delay="10 days")).drop("batch_id")


@query("t06_stream_usage_hourly", "SELECT api_key, endpoint, hour, requests, success, errors, round(avg_ms, 6) AS avg_ms FROM hourly")
def _(v):
    usage = N.with_event_time(streamed(v).usage_events)
    rows = N.newest_version(N.run_to_files(N.stream_usage_hourly(usage), "update"), ["api_key", "endpoint", "hour"])
    return rows.withColumn("avg_ms", F.round("avg_ms", 6))


SQL_VIEWS["cool"] = """SELECT wallet, severity, created_at FROM first_alert UNION ALL
    SELECT c.wallet, c.severity, (SELECT min(a.created_at) FROM alerts a WHERE a.wallet = c.wallet AND a.severity = c.severity AND a.created_at > c.created_at + 86400) FROM cool c
    WHERE EXISTS (SELECT 1 FROM alerts a WHERE a.wallet = c.wallet AND a.severity = c.severity AND a.created_at > c.created_at + 86400)"""
SQL_VIEWS["first_alert"] = "SELECT wallet, severity, min(created_at) AS created_at FROM alerts GROUP BY 1, 2"


@query("t07_stream_alerts", "SELECT wallet, severity, 'burst ' || severity AS reason, created_at FROM cool")
def _(v):
    S.use_rocksdb(v.spark)
    rows = v.alerts.select("wallet", "severity", "reason", F.col("created_at").alias("ts"))
    stream = replayed(v, rows, "wallet string, severity string, reason string, ts bigint")
    return N.run_to_files(S.stream_alerts(stream, P.AlertConfig(cooldown_s=DAY), "10 days")).drop("batch_id")


@query("t08_stream_escalation", "SELECT wallet, ts, score, stage, tier, last_alert_ts, last_clean_ts FROM esc_end")
def _(v):
    S.use_rocksdb(v.spark)
    rows = replayed(v, S.escalation_input(observations(v), v.alerts), "wallet string, ts bigint, tag string")
    return S.with_stage(N.newest_version(N.run_to_files(S.stream_escalation(rows, delay="10 days")), ["wallet"]))


@query("t09_stream_check_transfers", ORACLE["q16_check_transfers"])
def _(v):
    return N.run_to_files(check_transfers(proposed(streamed(v)), receivers(v))).drop("batch_id")


@query("t10_stream_rolling", """SELECT s AS window_start, s + 604800 AS window_end, wallet, CAST(sum(amount_lamports) AS BIGINT) AS volume, count(*) AS tx_count FROM (
    SELECT *, unnest(range(ts // 86400 * 86400 - 518400, ts // 86400 * 86400 + 1, 86400)) AS s FROM transfers) GROUP BY 1, 3""")
def _(v):
    rows = N.run_to_files(N.stream_rolling(transfers(v)), "update")
    return N.newest_version(rows, ["window_start", "window_end", "wallet"])
