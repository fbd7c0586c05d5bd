"""Risk spreading over the transfer graph and identity clusters."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import DAY, clamp, clean_wallet, join_skewed, newest_n, rnd
from ledgerwise.functions.storage import cut_lineage, release, release_path, shared_dir
from ledgerwise.operators.graph import adjacency, any_bit, bit_places, connected_components, k_hop_neighbors, own_bits


#: Sources that are walked together, and neighbours of a node that one task of a step meets.
BLOCK_SOURCES = 10_000
HUB = 100_000
#: Longs in a set of sources of a dense graph.
WORDS = 16


@contextmanager
def bucketed_neighbors(edges: DataFrame, hub: int = HUB) -> Iterator[DataFrame]:
    """(x, salt, y, parts, amount, last_ts): both directions of the edges, bucketed by (x, salt) for the time of the block.

    A node with more than ``hub`` neighbours is spread over several salts; ``parts`` is the number of salts of y.
    Written once, the table joins any number of frontiers without being shuffled again.
    """
    spark = edges.sparkSession
    ends = cut_lineage(edges.select(
        F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                          F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "amount", "last_ts",
    ).select("e.*", "amount", "last_ts"))
    parts = F.ceil(F.count(F.lit(1)) / hub).cast("int")
    degree = cut_lineage(ends.groupBy(F.col("x").alias("node")).agg(parts.alias("parts")))
    rows = ends.join(degree.select(F.col("node").alias("x"), F.col("parts").alias("_x")), "x").join(
        degree.select(F.col("node").alias("y"), "parts"), "y")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("y"), F.col("_x")).cast("int")).drop("_x")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"neighbors_{uuid.uuid4().hex}", f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    rows.repartition(n, "x", "salt").write.bucketBy(n, "x", "salt").sortBy("x", "salt").option("path", path).saveAsTable(name)
    table = spark.table(name)
    try:
        yield table
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for step in (ends, degree):
            release(step)
        release_path(spark, path)


def _hits(neighbors: DataFrame, sources: DataFrame, max_depth: int, words: int) -> Iterator[tuple[int, DataFrame, list[str]]]:
    """(depth, hits, words): rows (g, node, parts, amount, last_ts, words), the sources that first reach the node at that
    depth by this edge, which comes from their smallest predecessor.

    A neighbour of a level lies in the level before, in the same or in the next one, so what these two hold is not new.
    The edges into a node are met in the order of their other ends, and each takes the sources that none before it had.
    """
    home = neighbors.join(sources.select(F.col("wallet").alias("y")), "y", "left_semi").groupBy("y").agg(F.max("parts").alias("parts"))
    home = cut_lineage(home)
    places, names = bit_places(home, "y", words)
    level = cut_lineage(places.join(home, "y").select("g", F.col("y").alias("node"), "parts", *own_bits(names)))
    before = None
    w = Window.partitionBy("g", "node").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, -1)
    for depth in range(1, max_depth + 1):
        frontier = level.select("g", F.col("node").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), *names)
        met = frontier.join(neighbors, ["x", "salt"]).select("g", F.col("y").alias("node"), "x", "parts", "amount", "last_ts", *names)
        old = level if before is None else level.unionByName(before)
        rows = met.unionByName(old.select("g", "node", *names), allowMissingColumns=True)
        new = rows.select("g", "node", "x", "parts", "amount", "last_ts", *[
            F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(c).over(w), F.lit(0)))).alias(c) for c in names])
        hits = cut_lineage(new.filter(F.col("x").isNotNull() & any_bit(names)).drop("x"))
        yield depth, hits, names
        if before is not None:
            release(before)
        before = level
        if depth < max_depth:
            level = cut_lineage(hits.groupBy("g", "node").agg(F.max("parts").alias("parts"), *[F.bit_or(c).alias(c) for c in names]))
        release(hits)
    for df in (before, level):
        release(df)


def reach_sums(edges: DataFrame, scam: DataFrame, weights: Mapping[str, Column], max_depth: int = 3,
               block_sources: int = BLOCK_SOURCES, hub: int = HUB, words: int = WORDS) -> DataFrame:
    """(wallet, depth, one decimal sum per weight) over the breadth-first reach of each scam wallet.

    A weight is an expression of depth and of amount and last_ts of the edge that first reached the wallet (the smallest
    of the predecessors one level up).  Scam wallets are walked through but not reported.  Sources are walked in
    blocks, as bits of sets of 64 * ``words``: an edge counts its weight once per set, times the sources that came by it,
    so a step has one row per edge and set and no pairs of sources and wallets.
    """
    bad = cut_lineage(scam.select("wallet").filter("wallet IS NOT NULL").distinct())
    blocks = max(1, -(-bad.count() // block_sources))
    sums = None
    with bucketed_neighbors(edges, hub) as neighbors:
        for k in range(blocks):
            block = bad.filter(F.pmod(F.xxhash64("wallet"), F.lit(blocks)) == k)
            for depth, hits, names in _hits(neighbors, block, max_depth, words):
                n = reduce(Column.__add__, [F.bit_count(c) for c in names])
                found = hits.select(F.col("node").alias("wallet"), F.lit(depth).alias("depth"), "amount", "last_ts",
                                    n.cast("decimal(9,0)").alias("_n")).join(bad, "wallet", "left_anti")
                part = cut_lineage(found.groupBy("wallet", "depth").agg(*[
                    F.sum(w.cast("decimal(28,9)") * F.col("_n")).cast("decimal(38,9)").alias(name) for name, w in weights.items()]))
                sums = part if sums is None else sums.unionByName(part)
    return sums.groupBy("wallet", "depth").agg(*[F.sum(name).alias(name) for name in weights])


def reach_penalty(as_of: int, depth_penalties, scale, decay_days) -> F.Column:
    """Penalty of one reached node from its depth, edge amount and edge age."""
    by_depth = F.when(F.col("depth") == 1, depth_penalties[0]).when(F.col("depth") == 2, depth_penalties[1]).otherwise(
        depth_penalties[2])
    size = F.least(F.lit(1.0), F.log10(F.col("amount") + 1) / 3)
    age = (F.lit(as_of) - F.col("last_ts")) / float(DAY)
    return by_depth * size * scale * F.exp(-age / F.greatest(decay_days, F.lit(1.0)))


def propagate_scam_penalty(edges_undirected: DataFrame, scam: DataFrame, as_of: int,
                           cfg: P.PropagationConfig = P.PropagationConfig(), block_sources: int = BLOCK_SOURCES) -> DataFrame:
    pen = reach_penalty(as_of, [F.lit(float(p)) for p in cfg.penalties], F.lit(cfg.scale), F.lit(float(cfg.decay_days)))
    sums = reach_sums(edges_undirected, scam, {"penalty": pen}, cfg.max_depth, block_sources)
    return sums.groupBy("wallet").agg(F.sum("penalty").cast("double").alias("penalty"))


def propagation_updates(penalties: DataFrame, degrees: DataFrame, scores: DataFrame, base: float = 50.0) -> DataFrame:
    return penalties.join(degrees.select("wallet", "degree"), "wallet", "left").join(
        scores.select("wallet", F.col("score").alias("_base")), "wallet", "left").select(
        "wallet", F.lit("SCAM_CLUSTER_MEMBER").alias("reason_code"),
        rnd(F.col("penalty")).cast("int").alias("weight"),
        F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / 10.0).alias("confidence"),
        F.greatest(F.lit(0.0), F.coalesce("_base", F.lit(base)) + F.col("penalty")).alias("score"),
    )


def propagation_hits(edges: DataFrame, latest_scores: DataFrame,
                     cfg: P.NeighborPenaltyConfig = P.NeighborPenaltyConfig()) -> DataFrame:
    """Every (anomalous source, affected wallet) within the hop limit, with its decayed penalty.

    Seeds are only the anomalous wallets; the hop relation is symmetric.
    """
    bad = latest_scores.filter("is_anomalous").select("wallet")
    reach = k_hop_neighbors(edges, bad, cfg.max_hops, WORDS)
    decay = F.pow(F.lit(cfg.decay), F.col("hop"))
    return reach.select(F.col("seed").alias("source"), F.col("wallet").alias("affected"), "hop",
                        decay.alias("decay"), (F.lit(cfg.base) * decay).alias("penalty"))


def nearest_sources(edges: DataFrame, sources: DataFrame, hops: int, enough: int) -> DataFrame:
    """(wallet, source, hop) with the fewest hops from a source to each wallet, at most ``enough`` sources handed on per
    wallet and hop.

    A wallet passes on only its first ``enough`` sources of a hop.  So a step has at most ``enough`` rows per edge,
    and a wallet lacks a source only if it sees at least ``enough`` others that are as near.
    """
    adj = cut_lineage(adjacency(edges))
    level = sources.select("wallet", F.col("wallet").alias("source"), F.lit(0).alias("hop"))
    found = level
    for hop in range(1, hops + 1):
        met = level.join(adj, "wallet").select(F.col("neighbor").alias("wallet"), "source", F.lit(hop).alias("hop"))
        near = found.unionByName(met).groupBy("wallet", "source").agg(F.min("hop").alias("hop"))
        if hop == hops:
            return near.filter("hop > 0")
        new = near.filter(F.col("hop") == hop)
        level = cut_lineage(newest_n(new, ["wallet"], [F.col("source")], enough))
        found = found.unionByName(level)
    return found.filter("hop > 0")


def anomalous_neighbor_penalty(edges: DataFrame, latest_scores: DataFrame, base: DataFrame,
                               cfg: P.NeighborPenaltyConfig = P.NeighborPenaltyConfig()) -> DataFrame:
    """Score less the capped sum of the decayed penalties of anomalous wallets within the hop limit.

    So many sources at the largest distance reach the cap; a wallet needs no more witnesses than that.
    """
    enough = math.ceil(cfg.cap / (cfg.base * cfg.decay ** cfg.max_hops)) + 1  # one of them may be the wallet itself
    bad = latest_scores.filter("is_anomalous").select(clean_wallet("wallet").alias("wallet")).distinct()
    near = nearest_sources(edges, bad, cfg.max_hops, enough)
    total = near.groupBy("wallet").agg(F.least(
        F.lit(cfg.cap), F.sum(F.lit(cfg.base) * F.pow(F.lit(cfg.decay), F.col("hop")))).alias("penalty"))
    penalty = F.coalesce("penalty", F.lit(0.0))
    return base.select("wallet", F.col("score").alias("_s")).join(total, "wallet", "left").select(
        "wallet", penalty.alias("penalty"), clamp(rnd(F.col("_s") - penalty, 2)).alias("adjusted_score"))


def bidirectional_pairs(edges: DataFrame, min_tx: int = 2) -> DataFrame:
    strong = edges.filter(F.col("tx_count") >= min_tx)
    one = strong.filter("sender < receiver").select(F.col("sender").alias("a"), F.col("receiver").alias("b"))
    two = strong.filter("sender > receiver").select(F.col("receiver").alias("a"), F.col("sender").alias("b"))
    return one.join(two, ["a", "b"], "left_semi")


def shared_funding_sets(edges: DataFrame, min_fan: int = 2) -> DataFrame:
    """Rows (sender, wallet): the receivers of every sender with at least ``min_fan`` of them.

    Edges are unique per (sender, receiver), so a plain count is the set size and
    no member list is ever gathered in one task.
    """
    fan = edges.groupBy("sender").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_fan)
    return edges.join(fan, "sender", "left_semi").select("sender", F.col("receiver").alias("wallet"))


def fan_out_sets(edges: DataFrame, min_fan: int = 2) -> DataFrame:
    sets = shared_funding_sets(edges, min_fan)
    return sets.union(sets.select("sender", F.col("sender").alias("wallet")).distinct())


def burst_timing_sets(edges: DataFrame, window_s: int = 604_800, max_buckets: int | None = None) -> DataFrame:
    """Rows (bucket, wallet) of the time buckets with at least two wallets, or of the newest ``max_buckets`` of them."""
    rows = edges.filter("last_ts IS NOT NULL").select(
        F.floor(F.col("last_ts") / window_s).alias("bucket"),
        F.explode(F.array("sender", "receiver")).alias("wallet")).distinct()
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    if max_buckets is not None:
        sizes = sizes.orderBy(F.desc("bucket")).limit(max_buckets)
    return rows.join(sizes.select("bucket"), "bucket", "left_semi")


def identity_clusters(edges: DataFrame, cfg: P.ClusterConfig = P.ClusterConfig()) -> DataFrame:
    """Wallet sets that overlap are merged; tags tell which kinds of sets contributed.

    Each set becomes a star around its smallest member, so merging is a
    connected-components run over |members| edges instead of pairwise set tests.
    """
    if cfg.max_edges is not None:
        edges = edges.orderBy(F.desc_nulls_last("last_ts"), "sender", "receiver").limit(cfg.max_edges)
    e = cut_lineage(edges)
    pairs = bidirectional_pairs(e, cfg.min_tx)
    both = pairs.select(F.concat_ws("|", "a", "b").alias("set_id"), F.explode(F.array("a", "b")).alias("wallet"))
    tagged = [
        both.withColumn("tag", F.lit("bidirectional")),
        shared_funding_sets(e, cfg.min_fan).select(F.col("sender").alias("set_id"), "wallet")
        .withColumn("tag", F.lit("shared_funding")),
        fan_out_sets(e, cfg.min_fan).select(F.col("sender").alias("set_id"), "wallet")
        .withColumn("tag", F.lit("fan_in_out")),
        burst_timing_sets(e, cfg.window_s, cfg.max_buckets).select(F.col("bucket").cast("string").alias("set_id"), "wallet")
        .withColumn("tag", F.lit("burst_timing")),
        both.withColumn("tag", F.lit("circular")),
    ]
    rows = cut_lineage(reduce(DataFrame.unionByName, tagged))
    hubs = rows.groupBy("tag", "set_id").agg(F.min("wallet").alias("hub"))
    stars = rows.join(hubs, ["tag", "set_id"]).select(F.col("hub").alias("a"), F.col("wallet").alias("b")).distinct()
    components = cut_lineage(connected_components(stars))
    tags = rows.select("wallet", "tag").distinct().join(components, "wallet").groupBy("component").agg(
        F.array_sort(F.collect_set("tag")).alias("reason_tags"), F.count_distinct("wallet").alias("size"))
    confidence = F.least(F.lit(1.0), rnd(
        0.4 + 0.1 * F.size("reason_tags") + 0.05 * F.least(F.col("size") - 2, F.lit(4)), 2))
    kept = cut_lineage(tags.withColumn("confidence", confidence).filter(
        (F.col("size") >= 2) & (F.col("confidence") >= cfg.min_confidence)))
    return join_skewed(components, kept, "component", "size").select(
        F.col("component").alias("cluster_id"), "wallet", "confidence", "reason_tags", "size")


def cluster_risk(members: DataFrame, latest_scores: DataFrame) -> DataFrame:
    risky = (F.col("score") < 70) | F.col("is_anomalous")
    stats = members.select("cluster_id", "wallet").distinct().join(
        latest_scores.select("wallet", "score", "is_anomalous"), "wallet", "left").groupBy("cluster_id").agg(
        F.min("score").alias("_low"), F.count_if(risky).alias("risky_count"))
    risk = (100 - F.col("_low")) * 0.25 + F.col("risky_count") * 2.0
    return stats.select("cluster_id", F.when(F.col("_low").isNull(), 0.0).otherwise(
        rnd(F.least(F.lit(15.0), risk), 2)).alias("risk"), "risky_count")


def apply_cluster_penalty(scores: DataFrame, members: DataFrame, risks: DataFrame) -> DataFrame:
    per_wallet = members.join(risks, "cluster_id").groupBy("wallet").agg(F.max("risk").alias("risk"))
    penalty = F.coalesce(F.least(F.lit(15.0), F.col("risk")), F.lit(0.0))
    return scores.select("wallet", "score").join(per_wallet, "wallet", "left").select(
        "wallet", clamp(rnd(F.col("score") - penalty, 2)).alias("score"))
