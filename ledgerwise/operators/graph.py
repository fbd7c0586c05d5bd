"""Transfer-graph operators: edges, components, distances, neighbourhoods, paths."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwise.functions.common import DAY, LAMPORTS_PER_SOL, both_ends, clean_wallet, join_skewed, newest_n, rnd
from ledgerwise.functions.storage import cut_lineage, cut_with_metrics, release


def transfer_edges(transfers: DataFrame) -> DataFrame:
    s, r = clean_wallet("sender"), clean_wallet("receiver")
    return (
        transfers.select(s.alias("sender"), r.alias("receiver"), "amount_lamports", "ts")
        .filter("sender IS NOT NULL AND receiver IS NOT NULL AND sender <> receiver")
        .groupBy("sender", "receiver")
        .agg(F.count(F.lit(1)).alias("tx_count"), F.coalesce(F.sum("amount_lamports"), F.lit(0)).alias("volume"),
             F.max("ts").alias("last_ts"))
    )


def undirected_edges(transfers: DataFrame, as_of: int, days_back: int = 30, min_sol: float = 0.001) -> DataFrame:
    """Unordered pairs with Σ SOL of the transfers that are large and recent enough."""
    floor = int(round(min_sol * LAMPORTS_PER_SOL))
    df = transfers.filter(F.col("amount_lamports") >= floor)
    if days_back > 0:
        df = df.filter(F.col("ts") >= as_of - days_back * DAY)
    s, r = clean_wallet("sender"), clean_wallet("receiver")
    return (
        df.select(F.least(s, r).alias("a"), F.greatest(s, r).alias("b"), "amount_lamports", "ts",
                  (s.isNotNull() & r.isNotNull() & (s != r)).alias("_ok"))
        .filter("_ok").groupBy("a", "b")
        .agg((F.sum("amount_lamports") / float(LAMPORTS_PER_SOL)).alias("amount"), F.max("ts").alias("last_ts"))
    )


def _pairs(edges: DataFrame) -> DataFrame:
    src, dst = ("a", "b") if "a" in edges.columns else ("sender", "receiver")
    return edges.select(F.col(src).alias("wallet"), F.col(dst).alias("neighbor"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (wallet, neighbor) in both directions, no self-loops."""
    both = F.explode(F.array(F.struct("wallet", "neighbor"),
                             F.struct(F.col("neighbor").alias("wallet"), F.col("wallet").alias("neighbor"))))
    return (
        _pairs(edges).filter("wallet IS NOT NULL AND neighbor IS NOT NULL AND wallet <> neighbor")
        .select(both.alias("e")).select("e.*").distinct()
    )


#: Links that one task contracts without a shuffle; every turn of more links is shuffled.
TASK_LINKS = 50_000


def _in_one(df: DataFrame, rows: int | None) -> DataFrame:
    """A small step as one task: joins and groups of such steps need no shuffle."""
    return df if rows is None or rows > TASK_LINKS else df.coalesce(1)


def contract(links: DataFrame, turn: int, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((node, root), links among the roots): every node joins the first of itself and its neighbours in a random order.

    The order is a hash of the node and the turn, so in expectation at least a quarter of the nodes go with each turn,
    whatever the shape of the graph, and with them their links.  ``rows`` is the number of links, if known.
    """
    links = _in_one(links, rows)
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("x"))
    ends = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    roots = cut_lineage(ends.groupBy("u").agg(F.min(rank("v")).alias("first")).select(
        F.col("u").alias("node"), F.least(rank("u"), F.col("first"))["x"].alias("root")))
    ends = _in_one(roots, rows)
    left = ends.select(F.col("node").alias("u"), F.col("root").alias("_u"))
    right = ends.select(F.col("node").alias("v"), F.col("root").alias("_v"))
    rest = links.join(left, "u").join(right, "v").filter("_u <> _v").select(
        F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct()
    return roots, cut_lineage(rest)


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Smallest wallet id of each component, by contraction.

    Each turn replaces the nodes by their roots, so the links shrink geometrically until none is left; the turns' root
    tables, of falling size too, are joined from the last to the first.  Turns of at most ``TASK_LINKS`` links run in one task
    each, without shuffles.  Minima are combined map-side; hubs
    are split by adaptive skew joins.  Self-edges keep isolated wallets in the result.
    """
    pairs = cut_lineage(_pairs(edges).filter("wallet IS NOT NULL AND neighbor IS NOT NULL").distinct())
    pairs = _in_one(pairs, pairs.count())
    nodes = pairs.select(F.explode(F.array("wallet", "neighbor")).alias("wallet")).distinct()
    links = cut_lineage(pairs.filter("wallet <> neighbor").select(
        F.greatest("wallet", "neighbor").alias("u"), F.least("wallet", "neighbor").alias("v")).distinct())
    turns: list[tuple[DataFrame, int]] = []
    while rows := links.count():
        if len(turns) == max_rounds:
            raise RuntimeError("connected components did not converge")
        roots, rest = contract(links, len(turns), rows)
        release(links)
        turns.append((roots, rows))
        links = rest
    if not turns:
        return nodes.select("wallet", F.col("wallet").alias("component"))
    found = _in_one(*turns[-1])
    for roots, rows in reversed(turns[:-1]):
        last = found.select(F.col("node").alias("root"), F.col("root").alias("_last"))
        found = _in_one(roots, rows).join(last, "root", "left").select("node", F.coalesce("_last", "root").alias("root"))
    rows = turns[0][1]
    found = _in_one(cut_lineage(found), rows)
    for roots, _ in turns:
        release(roots)
    least = _in_one(cut_lineage(found.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("_n"))), rows)
    named = join_skewed(found, least, "root", "_n").select(F.col("node").alias("wallet"), "component")
    return nodes.join(named, "wallet", "left").select("wallet", F.coalesce("component", "wallet").alias("component"))


def component_stats(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Per wallet: component, its size, number of distinct neighbours and Σ edge amount."""
    a, b = ("a", "b") if "a" in edges.columns else ("sender", "receiver")
    amount = "amount" if "amount" in edges.columns else "volume"
    ends = edges.filter(F.col(a) != F.col(b)).select(
        F.explode(F.array(F.struct(F.col(a).alias("wallet"), F.col(b).alias("neighbor")),
                          F.struct(F.col(b).alias("wallet"), F.col(a).alias("neighbor")))).alias("e"),
        F.col(amount).cast("decimal(28,9)").alias("x"),
    ).select("e.*", "x")
    per_pair = ends.groupBy("wallet", "neighbor").agg(F.sum("x").alias("x"))
    degree = per_pair.groupBy("wallet").agg(F.count(F.lit(1)).alias("degree"),
                                            F.sum("x").cast("double").alias("volume"))
    components = cut_lineage(components)
    sizes = cut_lineage(components.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    return join_skewed(components, sizes, "component", "size").join(degree, "wallet", "left").select(
        "wallet", "component", "size", F.coalesce("degree", F.lit(0)).alias("degree"),
        F.coalesce("volume", F.lit(0.0)).alias("volume"),
    )


def distance_to_sources(edges: DataFrame, sources: DataFrame, max_depth: int | None = None,
                        unreachable: int = -1) -> DataFrame:
    """Fewest hops from the nearest source, walking the frontier one hop per round."""
    adj = cut_lineage(adjacency(edges))
    nodes = adj.select("wallet").distinct()
    count = F.count(F.lit(1))
    level, found = cut_with_metrics(
        nodes.join(sources.select(clean_wallet("wallet").alias("wallet")).distinct(), "wallet", "left_semi"), n=count)
    levels, before = [level], level.limit(0)
    while found["n"] and (max_depth is None or len(levels) <= max_depth):
        reached = level.join(adj, "wallet").select(F.col("neighbor").alias("wallet")).distinct()
        # a neighbour of this level lies in the previous, the same or the next one
        step, found = cut_with_metrics(reached.join(before.union(level), "wallet", "left_anti"), n=count)
        levels.append(step)
        before, level = level, step
    seen = reduce(DataFrame.union, [df.withColumn("distance", F.lit(d)) for d, df in enumerate(levels)])
    return nodes.join(seen, "wallet", "left").select(
        "wallet", F.coalesce("distance", F.lit(unreachable)).alias("distance"))


def bit_places(keys: DataFrame, key: str, words: int) -> tuple[DataFrame, list[str]]:
    """((key, g, word, bit), names of the words): each distinct key is one bit of a group of ``words`` longs.

    Groups are cut from hash buckets that are three quarters full on average, so no task numbers all keys.
    """
    keys = cut_lineage(keys.select(key).filter(F.col(key).isNotNull()).distinct())
    n = keys.count()
    words = max(1, min(words, -(-n // 48)))
    buckets, size = max(1, -(-n // (48 * words))), 64 * words
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    placed = keys.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).withColumn("_at", at)
    return placed.select(key, (F.col("_bucket") + F.floor(F.col("_at") / size) * buckets).alias("g"),
                         F.floor(F.col("_at") % size / 64).cast("int").alias("word"),
                         (F.col("_at") % 64).cast("int").alias("bit")), [f"b{i}" for i in range(words)]


def own_bits(words: list[str]) -> list[Column]:
    """The words of a key alone, from its place."""
    return [F.when(F.col("word") == i, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("bigint")).alias(w)
            for i, w in enumerate(words)]


def any_bit(words: list[str]) -> Column:
    return reduce(Column.__or__, [F.col(w) != 0 for w in words])


#: Neighbours above which a wallet is a hub of a walk, and links of hubs that one task meets.
HUB_LINKS = 1_000
PART_LINKS = 250_000


def hub_links(edges: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """((wallet, neighbor, part) in both directions, the hubs, number of parts).

    Links of hubs carry the part of the neighbour, those of others have none.  Without hubs there is no such table.
    """
    adj = cut_lineage(adjacency(edges))
    parts = max(1, -(-adj.count() // PART_LINKS))
    many = F.col("_n") > max(HUB_LINKS, parts)
    hubs = cut_lineage(adj.groupBy("wallet").agg(F.count(F.lit(1)).alias("_n")).filter(many).select("wallet"))
    if hubs.isEmpty():
        release(hubs)
        return adj.withColumn("part", F.lit(None).cast("int")), None, parts
    part = F.when(F.col("_hub"), F.pmod(F.xxhash64("neighbor"), F.lit(parts)).cast("int"))
    links = cut_lineage(adj.join(hubs.withColumn("_hub", F.lit(True)), "wallet", "left").withColumn("part", part).drop("_hub"))
    release(adj)
    return links, hubs, parts


def met_by_hubs(level: DataFrame, links: DataFrame, hubs: DataFrame, parts: int, words: list[str]) -> DataFrame:
    """(g, wallet, words): the sets of the hubs of a level, united in each of their neighbours.

    A hub's sets go once to each part of the neighbours, where all links of hubs into these lie, so they are united
    where they meet: neither paths nor partly united sets are shuffled.
    """
    sets = level.join(hubs, "wallet", "left_semi").select(
        "wallet", F.struct("g", *words).alias("set"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rows = links.filter("part IS NOT NULL").unionByName(sets, allowMissingColumns=True).repartition(parts, "part")
    w = Window.partitionBy("part", "wallet")  # the sets of a hub, handed to its links of this part
    met = rows.withColumn("sets", F.collect_list("set").over(w)).filter("neighbor IS NOT NULL").select(
        "part", F.col("neighbor").alias("wallet"), F.explode("sets").alias("set")).select("part", "wallet", "set.*")
    return met.groupBy("part", "wallet", "g").agg(*[F.bit_or(w).alias(w) for w in words]).drop("part")


def hop_sets(edges: DataFrame, places: DataFrame, words: list[str], k: int,
             known: tuple[DataFrame, DataFrame | None, int] | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(hop, level): rows (g, wallet, words) with the seeds that first reach the wallet at that hop.

    Sets of seeds travel as words of bits and are united by ``bit_or``, so a step has one row per edge and group of
    seeds, not one per path; those of hubs are united before the shuffle (``met_by_hubs``).  ``known``: the edges' ``hub_links``.
    """
    links, hubs, parts = known or hub_links(edges)
    level = cut_lineage(places.select("g", F.col("seed").alias("wallet"), *own_bits(words)))
    seen = level
    for hop in range(1, k + 1):
        met = level.join(links.filter("part IS NULL"), "wallet").select("g", F.col("neighbor").alias("wallet"), *words)
        if hubs is not None:
            met = met.unionByName(met_by_hubs(level, links, hubs, parts, words))
        rows = met.unionByName(seen.select("g", "wallet", *[F.col(w).alias(f"_{w}") for w in words]), allowMissingColumns=True)
        level = cut_lineage(rows.groupBy("g", "wallet").agg(*[
            F.coalesce(F.bit_or(w), F.lit(0)).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(f"_{w}"), F.lit(0)))).alias(w)
            for w in words]).filter(any_bit(words)))
        yield hop, level
        seen = seen.unionByName(level)


#: Seeds that are walked together; the names of so many meet the sets as a broadcast.
BLOCK_SEEDS = 10_000


def k_hop_neighbors(edges: DataFrame, seeds: DataFrame, k: int = 2, words: int = 1, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(seed, wallet, hop): every wallet within ``k`` hops of a seed, with the fewest hops.

    Seeds are walked as bits of sets of 64 * ``words``; many words suit dense graphs.  Only the result has pairs: blocks of
    ``block_seeds`` seeds are walked one after the other, so shuffle files are those of one block, and the sets of a block are
    unfolded where they lie.
    """
    named = cut_lineage(seeds.select(clean_wallet("wallet").alias("seed")).filter("seed IS NOT NULL").distinct())
    blocks = max(1, -(-named.count() // block_seeds))
    known = hub_links(edges)
    found = []
    for b in range(blocks):
        own = named.filter(F.pmod(F.xxhash64("seed", F.lit("block")), F.lit(blocks)) == b)
        placed, names = bit_places(own, "seed", words)
        places = cut_lineage(placed)
        levels = [df.withColumn("hop", F.lit(hop)) for hop, df in hop_sets(edges, places, names, k, known)]
        if not levels:
            return places.select("seed", F.col("seed").alias("wallet"), F.lit(0).alias("hop")).limit(0)
        sets = reduce(DataFrame.unionByName, levels).select("g", "wallet", "hop", F.posexplode(F.array(*names)).alias("word", "bits"))
        found.append(sets.filter("bits <> 0").join(F.broadcast(places), ["g", "word"]).filter("getbit(bits, bit) = 1").select(
            "seed", "wallet", "hop"))
    for df in (named, *known[:2]):
        if df is not None:
            release(df)
    return reduce(DataFrame.unionByName, found)


def graph_cluster_features(edges: DataFrame, scam: DataFrame) -> DataFrame:
    adj = cut_lineage(adjacency(edges))
    pairs = adj.select(F.col("wallet").alias("a"), F.col("neighbor").alias("b"))
    bad = scam.select(clean_wallet("wallet").alias("neighbor")).distinct().withColumn("is_scam", F.lit(1))
    near = adj.join(bad, "neighbor", "left").groupBy("wallet").agg(
        F.count(F.lit(1)).alias("neighbor_count"), F.count("is_scam").alias("scam_neighbor_count"))
    components = cut_lineage(connected_components(pairs))
    sizes = cut_lineage(components.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size")))
    return (
        near.join(join_skewed(components, sizes, "component", "cluster_size"), "wallet")
        .join(distance_to_sources(pairs, scam), "wallet")
        .select("wallet", "neighbor_count", "scam_neighbor_count", "cluster_size",
                F.col("distance").alias("distance_to_scam"))
    )


def cluster_features(transfers: DataFrame, scam: DataFrame) -> DataFrame:
    edges = transfer_edges(transfers)
    components = cut_lineage(connected_components(edges))
    sizes = cut_lineage(components.groupBy("component").agg(F.count(F.lit(1)).alias("cluster_size")))
    ends = both_ends(transfers, "amount_lamports", self_once=False).filter("counterparty <> wallet")
    bad = scam.select(clean_wallet("wallet").alias("counterparty")).distinct().withColumn("is_scam", F.lit(1))
    per_pair = ends.groupBy("wallet", "counterparty").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_lamports").alias("x"))
    stats = per_pair.join(bad, "counterparty", "left").groupBy("wallet").agg(
        F.sum("n").alias("tx_count"), F.count(F.lit(1)).alias("unique_counterparties"),
        rnd(F.sum("x") / float(LAMPORTS_PER_SOL) / F.sum("n"), 6).alias("avg_tx_value"),
        F.coalesce(F.max("is_scam"), F.lit(0)).alias("is_connected_to_known_scam"),
    )
    return join_skewed(components, sizes, "component", "cluster_size").join(stats, "wallet").drop("component")


def simple_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 3) -> DataFrame:
    """All simple directed paths of 1..max_depth hops from the sources, with the summed edge weight."""
    steps = edges.select("sender", F.col("receiver").alias("_next"), F.col("volume").alias("_w"))
    paths = sources.select(F.col("wallet").alias("source"), F.array("wallet").alias("path"),
                           F.lit(0).cast("bigint").alias("weight"), F.lit(0).alias("depth"))
    found = None
    for depth in range(1, max_depth + 1):
        paths = (
            paths.join(steps, F.element_at("path", -1) == F.col("sender"))
            .filter(~F.array_contains("path", F.col("_next")))
            .select("source", F.array_append("path", F.col("_next")).alias("path"),
                    (F.col("weight") + F.col("_w")).alias("weight"), F.lit(depth).alias("depth"))
        )
        found = paths if found is None else found.unionByName(paths)
    return found


def log_weighted_edges(transfers: DataFrame, members: DataFrame, min_sol: float = 0.0) -> DataFrame:
    """Undirected Σ ln(SOL + 1) between members of the same cluster."""
    m = members.select("cluster_id", "wallet").distinct()
    t = transfers.filter((F.col("sender") != F.col("receiver"))
                         & (F.col("amount_lamports") >= int(min_sol * LAMPORTS_PER_SOL)))
    weight = F.log1p(F.col("amount_lamports") / float(LAMPORTS_PER_SOL))
    return (
        t.join(m.withColumnRenamed("wallet", "sender"), "sender")
        .join(m.withColumnRenamed("wallet", "receiver"), ["receiver", "cluster_id"])
        .groupBy("cluster_id", F.least("sender", "receiver").alias("a"), F.greatest("sender", "receiver").alias("b"))
        .agg(F.sum(weight.cast("decimal(28,9)")).cast("double").alias("weight"))
    )


def ego_graph(transfers: DataFrame, seeds: DataFrame, scores: DataFrame, scam: DataFrame, depth: int = 2,
              mode: str = "all", min_sol: float = 0.0, days_back: int = 0, as_of: int = 0,
              max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per seed the nodes within ``depth`` hops (all, or the nearest ``max_nodes``) and the edges among them."""
    t = transfers.filter(F.col("amount_lamports") >= int(min_sol * LAMPORTS_PER_SOL))
    if days_back > 0:
        t = t.filter(F.col("ts") >= as_of - days_back * DAY)
    edges = transfer_edges(t)
    reach = k_hop_neighbors(edges, seeds, depth).unionByName(
        seeds.select(F.col("wallet").alias("seed"), "wallet", F.lit(0).alias("hop")))
    bad = scam.select("wallet").distinct().withColumn("_scam", F.lit(True))
    nodes = reach.join(scores.select("wallet", "score"), "wallet", "left").join(bad, "wallet", "left").withColumn(
        "is_scam", F.coalesce("_scam", F.lit(False)))
    if mode == "scam_only":
        nodes = nodes.filter("is_scam OR hop = 0")
    if max_nodes is not None:
        nodes = newest_n(nodes, ["seed"], [F.col("hop"), F.col("wallet")], max_nodes, salt_cols=["wallet"])
    score = F.coalesce("score", F.lit(50.0))
    color = (F.when(F.col("is_scam"), "red").when(score >= 80, "green").when(score >= 50, "yellow")
             .otherwise("orange"))
    nodes = nodes.select("seed", "wallet", F.col("hop").alias("distance"), score.alias("score"), "is_scam",
                         color.alias("color"))
    inside = nodes.select("seed", "wallet")
    links = (
        edges.join(inside.withColumnRenamed("wallet", "sender"), "sender")
        .join(inside.withColumnRenamed("wallet", "receiver"), ["seed", "receiver"])
        .select("seed", "sender", "receiver", "tx_count", "volume", "last_ts")
    )
    return nodes, links


def cluster_subgraph(transfers: DataFrame, members: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = members.select("cluster_id", "wallet").distinct()
    nodes = m.join(scores.select("wallet", "score"), "wallet", "left").select(
        "cluster_id", "wallet", F.coalesce("score", F.lit(50.0)).alias("score"))
    links = (
        transfer_edges(transfers).join(m.withColumnRenamed("wallet", "sender"), "sender")
        .join(m.withColumnRenamed("wallet", "receiver"), ["receiver", "cluster_id"])
        .select("cluster_id", "sender", "receiver", "tx_count")
    )
    return nodes, links


def neighborhood_cluster(tx_raw: DataFrame, scam: DataFrame, known_programs: list[str], n: int | None = None,
                         min_len: int = 32, max_len: int = 48) -> DataFrame:
    """Wallet ∪ account keys of address length of all its transactions (or the newest ``n``), named by a hash of the
    sorted members."""
    recent = tx_raw.select("wallet", "signature", "block_time", "account_keys")
    if n is not None:
        recent = newest_n(recent, ["wallet"], [F.coalesce("block_time", F.lit(0)).desc(), F.col("signature").desc()], n)
    keys = recent.select("wallet", F.explode(F.array_append("account_keys", F.col("wallet"))).alias("node"))
    address = F.length("node").between(min_len, max_len) | (F.col("node") == F.col("wallet"))
    keys = keys.filter(~F.col("node").isin(*known_programs) & address).distinct()
    bad = scam.select(F.col("wallet").alias("node")).distinct().withColumn("_scam", F.lit(True))
    digest = F.sha2(F.array_join(F.array_sort(F.collect_set("node")), " "), 256)
    return keys.join(bad, "node", "left").groupBy("wallet").agg(
        F.concat(F.lit("cluster_"), F.substring(digest, 1, 12)).alias("cluster_id"),
        F.count(F.lit(1)).alias("cluster_size"),
        F.when(F.max("_scam"), "HIGH").otherwise("LOW").alias("cluster_risk"),
    )


def suspicious_tx_count(transfers: DataFrame, scam: DataFrame) -> DataFrame:
    """Transfers of a wallet whose counterparty, or the wallet itself, is a known scam wallet."""
    bad = scam.select("wallet").distinct().withColumn("_bad", F.lit(1))
    ends = both_ends(transfers).groupBy("wallet", "counterparty").count()
    marked = ends.join(bad, "wallet", "left").withColumnRenamed("_bad", "_own").join(
        bad.withColumnRenamed("wallet", "counterparty"), "counterparty", "left")
    hits = F.when(F.coalesce("_own", "_bad").isNotNull(), F.col("count")).otherwise(0)
    return marked.groupBy("wallet").agg(F.sum(hits).alias("n"))


def flow_to_scam(transfers: DataFrame, scam: DataFrame) -> DataFrame:
    sent = transfers.groupBy(F.col("sender").alias("wallet"), "receiver").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_lamports").alias("x"))
    bad = scam.select(F.col("wallet").alias("receiver")).distinct()
    return sent.join(bad, "receiver", "left_semi").groupBy("wallet").agg(
        F.sum("n").alias("tx_count"), (F.sum("x") / float(LAMPORTS_PER_SOL)).alias("sol"))


def cluster_scam_ratio(members: DataFrame, scam: DataFrame, scale: int = 2) -> DataFrame:
    bad = scam.select("wallet").distinct().withColumn("_bad", F.lit(1))
    return members.select("cluster_id", "wallet").distinct().join(bad, "wallet", "left").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        rnd(F.count("_bad").cast("double") / F.count(F.lit(1)), scale).alias("scam_ratio"))
