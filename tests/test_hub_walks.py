"""Hop pairs around hubs: blocks of seeds, and sets of hubs that are united before they are shuffled."""

import pytest
from pyspark.sql import functions as F

from ledgerwise.operators import graph as G


def hubs_and_chain(spark):
    """100 sources and 40 leaves meet each of 5 hubs; the last leaf starts a chain."""
    rows = [(f"{kind}{i}", f"h{j}") for kind, n in (("s", 100), ("l", 40)) for i in range(n) for j in range(5)]
    return spark.createDataFrame(rows + [("l39", "c0"), ("c0", "c1"), ("c1", "c2")], "sender string, receiver string"), rows


def walked(rows, seeds, k):
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()
    for s in seeds:
        seen, level = {s}, {s}
        for hop in range(1, k + 1):
            level = set().union(*(near.get(x, set()) for x in level)) - seen
            seen |= level
            out |= {(s, y, hop) for y in level}
    return out


@pytest.mark.parametrize("block, words, hub, links", [(10_000, 2, 20, 100), (30, 1, 20, 100), (30, 16, 130, 10_000), (7, 1, 1_000, 100)])
def test_pairs_of_any_blocks_and_hubs(spark, monkeypatch, block, words, hub, links):
    monkeypatch.setattr(G, "HUB_LINKS", hub)
    monkeypatch.setattr(G, "PART_LINKS", links)
    edges, rows = hubs_and_chain(spark)
    names = [f"s{i}" for i in range(100)] + ["h0", "c1", "gone"]
    seeds = spark.createDataFrame([(x,) for x in [*names, "s1", " s2 ", None]], "wallet string")
    got = G.k_hop_neighbors(edges, seeds, 3, words, block).collect()
    want = walked(rows + [("l39", "c0"), ("c0", "c1"), ("c1", "c2")], names, 3)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_sets_of_hubs_are_united_where_they_meet(spark, monkeypatch):
    """What leaves the tasks has one row per neighbour and group of seeds, not one per hub as well."""
    monkeypatch.setattr(G, "HUB_LINKS", 20)
    monkeypatch.setattr(G, "PART_LINKS", 100)
    edges, _ = hubs_and_chain(spark)
    links, hubs, parts = G.hub_links(edges)
    assert {r.wallet for r in hubs.collect()} == {f"h{j}" for j in range(5)} and parts > 5
    level = spark.createDataFrame([(g, f"h{j}", 1 << j) for g in range(3) for j in range(5)], "g bigint, wallet string, b0 bigint")
    met = G.met_by_hubs(level, links, hubs, parts, ["b0"])
    assert sorted(map(tuple, met.select("wallet", "g", "b0").collect())) == sorted(
        (f"{kind}{i}", g, 31) for kind, n in (("s", 100), ("l", 40)) for i in range(n) for g in range(3))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


def test_unfolding_shuffles_no_sets(spark):
    edges, _ = hubs_and_chain(spark)
    seeds = spark.range(100).select(F.concat(F.lit("s"), "id").alias("wallet"))
    assert "hashpartitioning" not in G.k_hop_neighbors(edges, seeds, 2, 2)._jdf.queryExecution().executedPlan().toString()
