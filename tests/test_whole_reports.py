"""Reports, histories and listings give every row unless a limit is asked for."""

from ledgerwise.operators import graph, ops, reports, timeseries
from ledgerwise.sources import tables

TRANSFER = ("signature string, wallet string, sender string, receiver string, amount_lamports bigint, ts bigint, slot bigint, "
            "program_id string, token string, err string")


def star(spark, n):
    return spark.createDataFrame([(f"s{i:04d}", "hub", "hub", f"p{i:04d}", 1, i, i, "p", "SOL", None) for i in range(n)], TRANSFER)


def scored(spark):
    return spark.createDataFrame([("hub", 60.0, "LOW")], "wallet string, score double, risk_level string")


def dashboard(spark, **more):
    codes = [("hub", f"C{i:02d}", 100 - i, f"x{i:02d}") for i in range(30)] + [("hub", " DRAINER_TX", 1, "x99"), ("hub", "C00", 2, "x98")]
    reasons = spark.createDataFrame(codes, "wallet string, reason_code string, created_at bigint, tx_hash string")
    badges = spark.createDataFrame([("hub", f"b{i:02d}", i // 2) for i in range(25)], "wallet string, badge string, ts bigint")
    return reports.wallet_dashboard(scored(spark), star(spark, 3), reasons, badges, 1_000, **more).collect()[0]


def test_dashboard_reads_all_reasons(spark):
    r = dashboard(spark)
    assert r.drainer_pattern is True
    assert r.reasons == [f"C{i:02d}" for i in range(30)] + ["DRAINER_TX"]
    assert r.badges == [f"b{i:02d}" for i in sorted(range(25), key=lambda i: (-(i // 2), i))]


def test_dashboard_limit_keeps_the_flag(spark):
    r = dashboard(spark, shown=20)
    assert r.drainer_pattern is True
    assert r.reasons == [f"C{i:02d}" for i in range(20)] and len(r.badges) == 20


def test_flow_paths_and_identity_graph(spark):
    members = spark.createDataFrame([(1, f"m{i:03d}") for i in range(110)] + [(1, "hub")], "cluster_id bigint, wallet string")
    t, s = star(spark, 120), scored(spark)
    rows = reports.flow_paths(t, members, s)
    assert rows.count() == 2 * 111 + 2 * 120  # linear in members and pairs
    hub = spark.createDataFrame([("hub",)], "wallet string")
    paths = {(r.target, r.relationship) for r in reports.paths_of(rows, hub).collect()}
    assert paths == {(f"m{i:03d}", "cluster") for i in range(110)} | {(f"p{i:04d}", "interaction") for i in range(120)}
    nodes, edges = reports.identity_graph(t, members, s)
    assert nodes.count() == 231 + 2 * 120 + 2 * 111 and edges.count() == 2 * 120 + 111
    assert nodes.filter("wallet = 'hub'").count() == 122 and edges.filter("wallet = 'hub'").count() == 121
    nodes, edges = reports.identity_graph(t, members, s, 10, 4)
    assert nodes.filter("wallet = 'hub'").count() == 10 and edges.filter("wallet = 'hub'").count() == 4


def test_ego_graph(spark):
    hub = spark.createDataFrame([("hub",)], "wallet string")
    nodes, edges = graph.ego_graph(star(spark, 230), hub, scored(spark), hub, depth=1)
    assert (nodes.count(), edges.count()) == (231, 230)


def test_histories_owners_and_errors(spark):
    assert tables.recent_history(star(spark, 520)).count() == 520
    owners = spark.createDataFrame([("m", f"w{i}") for i in range(105)] + [("m", "w1"), ("m", None)], "mint string, wallet string")
    assert tables.distinct_owners(owners).count() == 105
    old = spark.createDataFrame([("e", 50_000 * i, float(i)) for i in range(120)], "entity_id string, at bigint, score double")
    kept, trend = timeseries.entity_history(old, old.filter("at = 0").withColumn("score", old.score + 0.5))
    assert sorted((r.rank, r["at"], r.score) for r in kept.collect()) == [
        (k + 1, 50_000 * i, float(i)) for k, i in enumerate(range(119, 0, -1))] + [(120, 0, 0.5), (121, 0, 0.0)]
    assert [(r.trend, r.recent, r.older) for r in trend.collect()] == [("improving", 119.0, 110.0)]
    log = spark.createDataFrame([("s", i, "error", f"m{i}", "w", 1.0) for i in range(210)],
                                "stage string, ts bigint, status string, message string, wallet string, latency_ms double")
    assert ops.stage_health(log, 1_000)[1].count() == 210
