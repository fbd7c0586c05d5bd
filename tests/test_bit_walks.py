"""Walks that carry sets of sources as bits: right pairs and sums, and steps without one row per path."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerwise.operators import graph as G
from ledgerwise.operators import propagation as R


def dense(spark, sources=130, mids=12, leaves=40):
    """Every source and leaf meets every middle wallet: sources x mids x leaves paths of two hops."""
    pair = lambda n, name: spark.range(n).select(F.concat(F.lit(name), "id").alias("sender")).crossJoin(
        spark.range(mids).select(F.concat(F.lit("m"), "id").alias("receiver")))
    edges = pair(sources, "s").union(pair(leaves, "l"))
    return edges, spark.range(sources).select(F.concat(F.lit("s"), "id").alias("wallet"))


@pytest.mark.parametrize("words", [1, 3])
def test_pairs_within_two_hops_and_rows_of_a_step(spark, words):
    edges, seeds = dense(spark)
    blank = spark.createDataFrame([(" s0 ",), (None,), ("gone",)], "wallet string")
    rows = G.k_hop_neighbors(edges, seeds.union(seeds).union(blank), 2, words).collect()
    names = [f"s{i}" for i in range(130)]
    want = {(s, f"m{j}", 1) for s in names for j in range(12)}
    want |= {(s, x, 2) for s in names for x in [*names, *(f"l{i}" for i in range(40))] if x != s}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    placed, cols = G.bit_places(seeds.withColumnRenamed("wallet", "seed"), "seed", words)
    groups = placed.select("g").distinct().count()
    sizes = {hop: level.count() for hop, level in G.hop_sets(edges, placed, cols, 2)}
    assert sizes[1] <= 12 * groups and sizes[2] <= 170 * groups < 130 * 170 / 10


def test_places_are_unique(spark):
    keys = spark.range(1000).select(F.col("id").cast("string").alias("seed"))
    for words in (1, 4):
        placed, cols = G.bit_places(keys.union(keys), "seed", words)
        rows = placed.collect()
        assert len(rows) == len({r.seed for r in rows}) == len({(r.g, r.word, r.bit) for r in rows}) == 1000
        assert all(0 <= r.word < len(cols) and 0 <= r.bit < 64 for r in rows)


@pytest.mark.parametrize("words", [1, 2])
def test_sums_of_many_sources_and_rows_of_a_step(spark, words):
    edges, seeds = dense(spark)
    und = edges.select(F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b")).withColumns({
        "amount": F.pmod(F.xxhash64("a", "b"), F.lit(97)).cast("double"), "last_ts": F.pmod(F.xxhash64("b", "a"), F.lit(89))})
    near = defaultdict(dict)
    for r in und.collect():
        near[r.a][r.b] = near[r.b][r.a] = r.amount + r.last_ts
    bad, want = {f"s{i}" for i in range(130)}, defaultdict(float)
    for s in bad:
        seen, level = {s}, [s]
        for d in (1, 2, 3):
            new = {}
            for x in sorted(level):
                for y, e in near[x].items():
                    if y not in seen:
                        new.setdefault(y, e)
            seen, level = seen | set(new), list(new)
            for y, e in new.items():
                if y not in bad:
                    want[y, d] += e
    got = R.reach_sums(und, seeds, {"x": F.col("amount") + F.col("last_ts")}, 3, words=words).collect()
    assert {(r.wallet, r.depth) for r in got} == set(want)
    assert all(math.isclose(float(r.x), want[r.wallet, r.depth], abs_tol=1e-6) for r in got)
    with R.bucketed_neighbors(und) as neighbors:
        most = max(hits.count() for _, hits, _ in R._hits(neighbors, seeds, 3, words))
    assert most < 130 * 170 / 5
