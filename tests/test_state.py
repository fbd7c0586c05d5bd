"""State machines: batch fold and streams against a literal walk over the rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.operators import alerts as A
from ledgerwise.streaming import native as N
from ledgerwise.streaming import stateful as S

CFG = P.EscalationConfig()
HOUR, DAY = 3_600, 86_400
REASONS = {"burst_transactions": ("high", "Burst activity"), "suspicious_velocity": ("medium", "Suspicious velocity"),
           "risk_score": ("risk_score", "Trust score below"), "other_low": ("low", "something"), "other_page_me": ("Page_me", None)}


def walk(obs, alerts):
    """One wallet, row by row, over the full alert list."""
    score, last, clean = 0.0, None, None
    for ts, types in obs:
        clean = ts if clean is None else clean
        recent = [(t, k) for t, k in alerts if ts - 2 * DAY <= t <= ts]
        kinds, now = {k for _, k in recent}, set(types)
        hour = sum(1 for t, _ in recent if t >= ts - HOUR)
        if not now and not recent:
            if ts - clean >= 2 * DAY:
                score, last = 0.0, None
            elif last is not None and ts - last >= DAY:
                score = max(0.0, score - 12)
            clean = ts
            continue
        if not now and ts - clean >= DAY:
            score = max(0.0, score - 12)
        score += 6 * len(now) + 8 * len(now & kinds) + (12 if len(now | kinds) >= 2 else 0) + (15 if hour >= 3 else 0)
        score = min(100.0, score)
        last = ts if now else last
    return round(score, 2), last, clean


def make(seed, n_wallets=12):
    rng = random.Random(seed)
    obs, alerts = defaultdict(list), defaultdict(list)
    for i in range(n_wallets):
        w, t = f"w{i}", 1_000_000
        for _ in range(rng.randint(1, 60)):
            t += rng.choice([HOUR, 6 * HOUR, DAY, DAY + HOUR, 2 * DAY, 3 * DAY])
            types = rng.sample(["burst_transactions", "suspicious_velocity", "fresh_wallet_high_value"], rng.choice([0, 0, 0, 1, 2]))
            obs[w].append((t, sorted(types)))
            for _ in range(rng.choice([0, 0, 0, 0, 1, 4])):
                alerts[w].append((t - rng.randint(0, 4 * HOUR), rng.choice(list(REASONS))))
    return obs, alerts


def frames(spark, obs, alerts):
    o = spark.createDataFrame([(w, t, k) for w, v in obs.items() for t, k in v], "wallet string, ts bigint, types array<string>")
    a = spark.createDataFrame([(w, t, *REASONS[k]) for w, v in alerts.items() for t, k in v],
                              "wallet string, created_at bigint, severity string, reason string")
    return o, a


def test_fold_equals_walk(spark):
    for seed in (1, 2):
        obs, alerts = make(seed)
        out = A.escalation_state(*frames(spark, obs, alerts))
        got = {r["wallet"]: (r["score"], r["last_alert_ts"], r["last_clean_ts"]) for r in out.collect()}
        assert got == {w: walk(v, alerts[w]) for w, v in obs.items()}


def test_fold_continues_from_previous_state(spark):
    obs, alerts = make(3)
    o, a = frames(spark, obs, alerts)
    cut = 1_000_000 + 20 * DAY
    first = A.escalation_state(o.filter(F.col("ts") <= cut), a)
    second = A.escalation_state(o.filter(F.col("ts") > cut), a, first)
    got = {r["wallet"]: (r["score"], r["last_alert_ts"], r["last_clean_ts"]) for r in second.collect()}
    late = {w: v for w, v in obs.items() if v[-1][0] > cut}
    assert got == {w: walk(v, alerts[w]) for w, v in late.items()}


FAR = 10**9


def _arrival(rows, late_by, seed):
    """Rows in order of arrival: each up to ``late_by`` after its time."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r["ts"] + rng.choice([0, 0, 0, late_by]))


def test_stream_with_late_rows_equals_walk(spark, tmp_path):
    S.use_rocksdb(spark)
    obs, alerts = make(4, 6)
    rows = _arrival(S.escalation_input(*frames(spark, obs, alerts)).collect(), 2 * DAY, 1)
    stream = _stream(spark, str(tmp_path / "in"), rows, "wallet string, ts bigint, tag string", 5, ("~", FAR, "1|"))
    out = N.run_to_files(S.stream_escalation(stream, delay="2 days"))
    assert out.select("batch_id").distinct().count() > 1
    got = {r["wallet"]: (r["score"], r["last_alert_ts"], r["last_clean_ts"]) for r in N.newest_version(out, ["wallet"]).collect()}
    assert got == {w: walk(v, alerts[w]) for w, v in obs.items()}


def _stream(spark, path, df_rows, schema, files, end=None):
    step = len(df_rows) // files + 1
    for i in range(0, len(df_rows), step):
        spark.createDataFrame(df_rows[i:i + step], schema).coalesce(1).write.mode("append").parquet(path)
    if end:
        spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_risk_updates_keep_the_gap(spark, tmp_path):
    """Late and repeated rows; between the two bursts wallets are idle for so long that their state goes."""
    S.use_rocksdb(spark)
    rng = random.Random(5)
    burst = [rng.randint(0, 5_000) for _ in range(80)]
    times = burst + [burst[0]] * 5 + [50_000 + rng.randint(0, 2_000) for _ in range(30)]
    schema = "sender string, receiver string, ts bigint"
    rows = _arrival([{"sender": "a", "receiver": "b", "ts": t} for t in times], 1_000, 2)
    stream = _stream(spark, str(tmp_path / "in"), [("a", "b", r["ts"]) for r in rows], schema, 5, ("~", "~", FAR))
    inputs = spark.createDataFrame([("a", 90.0, -7.0), ("b", 12.0, -5.0)], "wallet string, score double, change double")
    out = N.run_to_files(S.stream_risk_update(stream, inputs, delay="1000 seconds", idle_s=10_000))
    want, last, start = [], None, {"a": 90, "b": 12}
    score = dict(start)
    for t in sorted(set(times)):
        if last is not None and t - last > 10_000:
            last, score = None, dict(start)
        if last is None or t - last >= 300:
            last = t
            for w, d in (("a", -7), ("b", -5)):
                score[w] = max(0, score[w] + d)
                want.append((w, t, score[w]))
    assert sorted((r["wallet"], r["ts"], r["new_score"]) for r in out.collect()) == sorted(want)


def test_cooldown_state_expires_without_loss(spark, tmp_path):
    S.use_rocksdb(spark)
    rng = random.Random(6)
    rows = [{"wallet": f"w{rng.randint(0, 3)}", "severity": rng.choice(["high", None]), "reason": "r", "ts": rng.randint(0, 40_000)} for _ in range(300)]
    arrived = [(r["wallet"], r["severity"], r["reason"], r["ts"]) for r in _arrival(rows, 900, 3)]
    schema = "wallet string, severity string, reason string, ts bigint"
    stream = _stream(spark, str(tmp_path / "in"), arrived, schema, 6, ("~", "~", "~", FAR))
    out = N.run_to_files(S.stream_alerts(stream, P.AlertConfig(cooldown_s=3_600), "900 seconds"))
    want, last = [], {}
    for w, sev, _, t in sorted(arrived, key=lambda r: r[3]):
        if (w, sev) not in last or t - last[w, sev] > 3_600:
            last[w, sev] = t
            want.append((w, sev or "", t))
    assert sorted((r["wallet"], r["severity"] or "", r["created_at"]) for r in out.collect()) == sorted(want)
    state = spark.read.format("statestore").option("path", state_checkpoint(out)).option("stateVarName", "state").load()
    assert state.count() == 0  # all cooldowns are over


def state_checkpoint(out):
    return out.inputFiles()[0].split("/out/")[0] + "/checkpoint"


def test_dedupe_across_batches_and_late_rows(spark, tmp_path):
    schema = "wallet string, signature string, ts bigint"
    data = [("a", "1", 10_000), ("a", "2", 20_000), ("a", "1", 10_000), ("b", "1", 21_000), ("a", "3", 19_900), ("a", "2", 20_000)]
    stream = N.with_event_time(_stream(spark, str(tmp_path / "in"), data, schema, 3))
    out = N.run_to_files(N.stream_dedupe(stream, "5 hours").select("wallet", "signature", "ts"))
    assert sorted((r["wallet"], r["signature"]) for r in out.collect()) == [("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]


def test_stream_features_equal_batch_after_several_batches(spark, small, tmp_path):
    from catalog.views import Views
    from ledgerwise.operators.features import wallet_features

    v = Views(spark, small)
    v.transfers.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = N.stream_transfers(spark, str(tmp_path / "in"), max_files=1)
    N.stream_features(stream, str(tmp_path / "h"), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "s")).withColumnRenamed("batch", "batch_id").drop("flags", "score")
    assert rows.select("batch_id").distinct().count() == 3
    got = N.newest_version(rows, ["wallet"])
    want = wallet_features(v.transfers)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_risk_inputs_cover_wallets_without_score(spark):
    from ledgerwise.streaming.stateful import DEFAULT_CHANGE, risk_inputs

    scores = spark.createDataFrame([("a", 80.0)], "wallet string, score double")
    reasons = spark.createDataFrame([("b", "X", -10.0, 1.0)], "wallet string, code string, weight double, days_old double")
    priors = spark.createDataFrame([], "wallet string, prior double")
    rows = {r.wallet: r for r in risk_inputs(scores, reasons, priors).collect()}
    assert rows["a"].score == 80.0 and rows["a"].change == DEFAULT_CHANGE
    assert rows["b"].score == 50.0 and rows["b"].change < 0


def test_history_runs_follow_from_the_batch_number():
    """Over 600 batches the runs read hold each batch once, are few, and exist when they are read, also by a replay."""
    there = set()
    for batch in range(600):
        for attempt in range(2):
            for level, first in N.finished_merges(batch):
                there -= set(N.parts_of(level, first))
            there.add((0, batch))
            runs = N.live_runs(batch)
            covered = [b for level, first in runs for b in range(first, first + N.FAN_IN**level)]
            assert covered == list(range(batch)) and set(runs) <= there
            assert len(runs) < N.FAN_IN * 4
            for level, first in N.finished_merges(batch + 1):
                assert set(N.parts_of(level, first)) <= there
                there.add((level, first))


def test_stream_features_read_few_runs_over_many_batches(spark, tmp_path):
    from ledgerwise.operators.features import wallet_features

    rows = [(f"s{i}", f"w{i % 3}", f"w{(i * 7) % 5}", 10**9 + i, 1000 + 60 * i, i, "p", None) for i in range(40)]
    schema = "signature string, sender string, receiver string, amount_lamports bigint, ts bigint, slot bigint, program_id string, err string"
    whole = spark.createDataFrame(rows, schema).withColumn("wallet", F.col("sender"))
    for i in range(0, 40, 4):
        spark.createDataFrame(rows[i:i + 4], schema).withColumn("wallet", F.col("sender")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = N.with_event_time(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    N.stream_features(stream, str(tmp_path / "h"), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "s")).withColumnRenamed("batch", "batch_id").drop("flags", "score")
    assert out.select("batch_id").distinct().count() == 10
    runs = sorted(p.name for p in (tmp_path / "h").iterdir() if p.is_dir())
    assert runs == ["run=0-8", "run=0-9", "run=1-0"]
    got, want = N.newest_version(out, ["wallet"]), wallet_features(whole)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
