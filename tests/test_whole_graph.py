"""Neighbourhood clusters read every transaction of a wallet; giant components don't go through one task."""

import random

from pyspark.sql import functions as F

from ledgerwise.functions.common import join_skewed
from ledgerwise.operators import graph
from ledgerwise.operators.graph import neighborhood_cluster

SCHEMA = "wallet string, signature string, block_time bigint, account_keys array<string>"


def made(spark):
    rows = [("hot", f"s{i:03d}", i, ["hot", "scam" if i == 0 else f"n{i}", "program"]) for i in range(45)]
    rows += [("cold", "c0", 7, ["cold", "n1"])]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("scam",)], "wallet string")


def found(df):
    return {r.wallet: (r.cluster_size, r.cluster_risk) for r in df.collect()}


def test_old_scam_contact_counts(spark):
    tx, scam = made(spark)
    assert found(neighborhood_cluster(tx, scam, ["program"], min_len=1)) == {"hot": (46, "HIGH"), "cold": (2, "LOW")}


def test_newest_is_opt_in(spark):
    tx, scam = made(spark)
    assert found(neighborhood_cluster(tx, scam, ["program"], n=30, min_len=1)) == {"hot": (31, "LOW"), "cold": (2, "LOW")}


def test_one_component_with_almost_all_wallets(spark):
    """Sizes reach the members of a giant component without a shuffle by its id."""
    pairs = spark.range(1, 4_000).selectExpr("concat('a', lpad(cast(id - 1 as string), 5, '0')) AS a", "'a00000' AS b", "1.0 AS amount").filter("a <> b")
    small = spark.range(50).selectExpr("concat('x', id) AS a", "concat('y', id) AS b", "2.0 AS amount")
    edges = pairs.union(small)
    got = graph.component_stats(edges, graph.connected_components(edges))
    sizes = {(r.component, r["size"]): r.n for r in got.groupBy("component", "size").agg(F.count("*").alias("n")).collect()}
    assert sizes[("a00000", 3_999)] == 3_999 and len(sizes) == 51 and sizes[("x7", 2)] == 2


def test_join_skewed_equals_join(spark):
    rows = spark.range(5_000).selectExpr("id", "IF(id < 4000, 0, id % 700) AS k")
    table = rows.groupBy("k").count()
    got = join_skewed(rows, table, "k", "count", share=10)
    assert sorted(map(tuple, got.select("k", "id", "count").collect())) == sorted(
        map(tuple, rows.join(table, "k").select("k", "id", "count").collect()))
    heavy = table.filter("count * 10 >= 5000").count()
    assert heavy == 1
    assert join_skewed(rows.limit(0), table.limit(0), "k", "count").collect() == []


def _plain_components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


def test_components_match_union_find(spark):
    """A long chain in order of the ids, a star, a ring of stars, random pairs, self-edges and nulls."""
    rng = random.Random(8)
    name = lambda i: f"n{i:05d}"
    pairs = [(name(i), name(i + 1)) for i in range(300)] + [(name(1000), name(1001 + i)) for i in range(200)]
    pairs += [(name(2000 + 10 * (i // 9)), name(2001 + i + i // 9)) for i in range(90)] + [(name(2000 + 10 * i), name(2000 + 10 * ((i + 1) % 10))) for i in range(10)]
    pairs += [(name(5000 + rng.randrange(400)), name(5000 + rng.randrange(400))) for _ in range(250)] + [("solo", "solo")]
    df = spark.createDataFrame(pairs + [(None, "x"), ("y", None)], "sender string, receiver string").repartition(5)
    got = {r.wallet: r.component for r in graph.connected_components(df).collect()}
    assert got == _plain_components(pairs)
    assert graph.connected_components(df.filter("sender = 'solo'")).collect() == [("solo", "solo")]
    assert graph.connected_components(df.limit(0)).collect() == []


def test_links_shrink_with_every_turn(spark):
    links = spark.range(3_000).selectExpr("id + 1 AS u", "id AS v")  # a chain in order of the ids
    sizes = [3_000]
    for turn in range(30):
        _, links = graph.contract(links, turn)
        sizes.append(links.count())
        if not sizes[-1]:
            break
    assert sizes[-1] == 0 and all(b <= 0.85 * a for a, b in zip(sizes, sizes[1:]) if a > 30)


def test_small_turns_of_contraction_need_no_shuffle(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = graph.cut_lineage
    links = cut(spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v")))
    monkeypatch.setattr(graph, "cut_lineage", seen)
    few = graph.contract(links, 0, 299)
    assert len(plans) == 2 and not any("Exchange hashpartitioning" in p for p in plans)
    monkeypatch.setattr(graph, "TASK_LINKS", 10)
    many = graph.contract(links, 0, 299)
    assert "Exchange hashpartitioning" in plans[2]
    assert [sorted(x.collect()) for x in few] == [sorted(x.collect()) for x in many]
    edges = links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(spark.createDataFrame([(500, 500)], "a bigint, b bigint"))
    for limit in (10, 100, 1_000):
        monkeypatch.setattr(graph, "TASK_LINKS", limit)
        assert {tuple(r) for r in graph.connected_components(edges).collect()} == {(i, 0) for i in range(300)} | {(500, 500)}
