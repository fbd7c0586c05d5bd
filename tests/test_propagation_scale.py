"""Risk spreading without source x wallet pairs: blocks of sources, salted hubs, saturating witnesses, against plain walks."""

import math
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.operators import propagation as R

AS_OF = 100 * 86_400


def graph(seed, n, m, hub=None):
    rng = random.Random(seed)
    edges = {}
    while len(edges) < m:
        a, b = sorted(rng.sample(range(n), 2))
        edges[f"n{a:03d}", f"n{b:03d}"] = (rng.randrange(1, 2000) / 4, rng.randrange(0, 100) * 86_400)
    if hub:
        for k in range(n):
            if k != hub:
                a, b = sorted((hub, k))
                edges[f"n{a:03d}", f"n{b:03d}"] = (float(k + 1), k * 3600)
    return edges


def walk(edges, sources, depth):
    """{(source, node): (hop, amount, ts)}: level by level, the smallest predecessor of the level before."""
    near = defaultdict(dict)
    for (a, b), e in edges.items():
        near[a][b] = near[b][a] = e
    out = {}
    for s in sources:
        if s not in near:
            continue
        seen, level = {s}, [s]
        for d in range(1, depth + 1):
            new = {}
            for x in sorted(level):
                for y, e in near[x].items():
                    if y not in seen and y not in new:
                        new[y] = e
            seen |= set(new)
            level = list(new)
            out |= {(s, y): (d, *e) for y, e in new.items()}
    return out


@pytest.mark.parametrize("block, hub", [(10_000, 100_000), (2, 3), (1, 1000)])
def test_blocks_and_salted_hubs_give_the_plain_sums(spark, block, hub):
    edges = graph(5, 60, 90, hub=7)
    scam = ["n001", "n020", "n033", "n040", "n059", "gone"]
    want = defaultdict(float)
    for (_, y), (d, amount, ts) in walk(edges, scam, 3).items():
        if y not in scam:
            want[y, d] += min(1, math.log10(amount + 1) / 3) * math.exp(-(AS_OF - ts) / 86_400 / 30)
    df = spark.createDataFrame([(a, b, *e) for (a, b), e in edges.items()], "a string, b string, amount double, last_ts long")
    bad = spark.createDataFrame([(w,) for w in [*scam, "n001", None]], "wallet string")
    size = F.least(F.lit(1.0), F.log10(F.col("amount") + 1) / 3)
    got = R.reach_sums(df, bad, {"x": size * F.exp(-(AS_OF - F.col("last_ts")) / 86_400 / 30)}, 3, block, hub).collect()
    assert {(r.wallet, r.depth) for r in got} == set(want)
    assert all(math.isclose(float(r.x), want[r.wallet, r.depth], abs_tol=1e-6) for r in got)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("neighbors_")]


def test_reach_of_nothing(spark):
    df = spark.createDataFrame([("a", "b", 1.0, 0)], "a string, b string, amount double, last_ts long")
    none = spark.createDataFrame([], "wallet string")
    assert R.propagate_scam_penalty(df, none, AS_OF).collect() == []
    assert R.propagate_scam_penalty(df.filter("false"), none.union(df.select("a")), AS_OF).collect() == []


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_saturating_witnesses_reach_the_same_penalty(spark, hops):
    """A third of the wallets is anomalous and one hub sees all of them."""
    edges = graph(9, 80, 160, hub=3)
    bad = {f"n{k:03d}" for k in range(0, 80, 3)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    cfg = P.NeighborPenaltyConfig(max_hops=hops)
    want = {}
    for w in near:
        hop, queue, total = {w: 0}, deque([w]), 0.0
        while queue:
            x = queue.popleft()
            for y in near[x]:
                if y not in hop and hop[x] < hops:
                    hop[y] = hop[x] + 1
                    queue.append(y)
        total = sum(cfg.base * cfg.decay ** d for y, d in hop.items() if y in bad and d)
        want[w] = min(cfg.cap, total)
    df = spark.createDataFrame([(a, b, 1, 1) for a, b in edges], "sender string, receiver string, tx_count long, volume long")
    scores = spark.createDataFrame([(w, 70.0, w in bad) for w in [*near, "alone"]], "wallet string, score double, is_anomalous boolean")
    got = {r.wallet: (r.penalty, r.adjusted_score) for r in R.anomalous_neighbor_penalty(df, scores, scores, cfg).collect()}
    assert got == {w: (p, round(70.0 - p, 2)) for w, p in {**want, "alone": 0.0}.items()}


def test_witness_rows_are_linear_in_edges(spark):
    """One middle wallet with many anomalous neighbours hands on no more than enough of them."""
    edges = spark.range(400).select(F.concat(F.lit("bad"), "id").alias("sender"), F.lit("middle").alias("receiver")).union(
        spark.range(300).select(F.lit("middle").alias("sender"), F.concat(F.lit("leaf"), "id").alias("receiver")))
    bad = spark.range(400).select(F.concat(F.lit("bad"), "id").alias("wallet"))
    rows = R.nearest_sources(edges, bad, 2, 15).groupBy("hop").count().collect()
    found = {r.hop: r["count"] for r in rows}
    assert found[1] == 15 and found[2] <= 15 * 701
