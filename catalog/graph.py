"""Graph queries over the event transfers (dense), their six-hour form (sparse) and the order transfers."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import AS_OF, AS_OF_ORDERS, SQL_VIEWS
from ledgerwise import params as P
from ledgerwise.operators import graph as G
from ledgerwise.operators import propagation as R

DAY = 86_400
D = "CAST(1e9 AS DOUBLE)"

_EDGES = """SELECT sender, receiver, count(*) AS tx_count, CAST(sum(amount_lamports) AS BIGINT) AS volume,
    max(ts) AS last_ts FROM {t} WHERE sender <> receiver GROUP BY 1, 2"""
SQL_VIEWS["edges"] = _EDGES.format(t="transfers")
SQL_VIEWS["edges_six"] = _EDGES.format(t="transfers_six_hour")
SQL_VIEWS["edges_large"] = _EDGES.format(t="transfers_large")
_UND = """SELECT least(sender, receiver) AS a, greatest(sender, receiver) AS b, sum(amount_lamports) / {d} AS amount,
    max(ts) AS last_ts FROM {t} WHERE sender <> receiver AND amount_lamports >= 1000000 AND ts >= {since} GROUP BY 1, 2"""
SQL_VIEWS["und"] = _UND.format(t="transfers", d=D, since=AS_OF - 30 * DAY)
SQL_VIEWS["und_six"] = _UND.format(t="transfers_six_hour", d=D, since=AS_OF - 30 * DAY)
_ADJ = "SELECT sender AS wallet, receiver AS neighbor FROM {e} UNION SELECT receiver, sender FROM {e}"
SQL_VIEWS["adj"] = _ADJ.format(e="edges")
SQL_VIEWS["adj_six"] = _ADJ.format(e="edges_six")
SQL_VIEWS["reach_six"] = """SELECT wallet AS node, wallet AS root FROM adj_six UNION
    SELECT a.neighbor, r.root FROM reach_six r JOIN adj_six a ON a.wallet = r.node"""
SQL_VIEWS["comp_six"] = "SELECT node AS wallet, min(root) AS component FROM reach_six GROUP BY 1"
SQL_VIEWS["bfs_six"] = """SELECT DISTINCT a.wallet, 0 AS d FROM adj_six a JOIN scam_six_hour USING (wallet) UNION
    SELECT a.neighbor, d + 1 FROM bfs_six b JOIN adj_six a ON a.wallet = b.wallet WHERE d < 40"""
SQL_VIEWS["dist_six"] = """SELECT n.wallet, coalesce(min(d), -1) AS distance FROM (SELECT DISTINCT wallet FROM adj_six) n
    LEFT JOIN bfs_six b ON b.wallet = n.wallet GROUP BY 1"""
_HOPS = """SELECT seed, wallet, min(hop) AS hop FROM (
      SELECT s.wallet AS seed, neighbor AS wallet, 1 AS hop FROM {s} s JOIN {a} ON {a}.wallet = s.wallet
      UNION ALL SELECT s.wallet, y.neighbor, 2 FROM {s} s JOIN {a} x ON x.wallet = s.wallet
        JOIN {a} y ON y.wallet = x.neighbor) WHERE seed <> wallet GROUP BY 1, 2"""
SQL_VIEWS["hops_six"] = _HOPS.format(s="scam_six_hour", a="adj_six")


def six(v):
    return G.transfer_edges(v.transfers_six_hour)


def und_six(v):
    return G.undirected_edges(v.transfers_six_hour, AS_OF)


@query("g01_transfer_edges", "SELECT * FROM edges")
def _(v):
    return G.transfer_edges(v.transfers)


@query("g01_transfer_edges_large", "SELECT * FROM edges_large")
def _(v):
    return G.transfer_edges(v.transfers_large)


@query("g02_undirected_edges", "SELECT a, b, round(amount, 6) AS amount, last_ts FROM und")
def _(v):
    return G.undirected_edges(v.transfers, AS_OF).withColumn("amount", F.round("amount", 6))


@query("g03_adjacency", "SELECT wallet, neighbor FROM edges_large_adj")
def _(v):
    return G.adjacency(G.transfer_edges(v.transfers_large))


SQL_VIEWS["edges_large_adj"] = _ADJ.format(e="edges_large")

@query("g04_connected_components", "SELECT wallet, component FROM comp_six")
def _(v):
    return G.connected_components(six(v))


@query("g04_connected_components_large", """SELECT w AS wallet, min(w) OVER () AS component FROM (
    SELECT sender AS w FROM edges_large UNION SELECT receiver FROM edges_large)""")
def _(v):
    return G.connected_components(G.transfer_edges(v.transfers_large))


@query("g05_component_stats", f"""SELECT c.wallet, component, size, degree, volume FROM comp_six c
    JOIN (SELECT component, count(*) AS size FROM comp_six GROUP BY 1) USING (component)
    JOIN (SELECT wallet, count(DISTINCT n) AS degree, sum(volume) / {D} AS volume FROM (
      SELECT sender AS wallet, receiver AS n, volume FROM edges_six UNION ALL SELECT receiver, sender, volume
      FROM edges_six) GROUP BY 1) d ON d.wallet = c.wallet""")
def _(v):
    edges = six(v).withColumn("amount", F.col("volume").cast("decimal(28,9)") / 1_000_000_000)
    return G.component_stats(edges, G.connected_components(edges))


@query("g06_distance_to_sources", "SELECT * FROM dist_six")
def _(v):
    return G.distance_to_sources(six(v), v.scam_six_hour)


@query("g06_distance_depth_4", """SELECT n.wallet, coalesce(min(d), 999) AS distance FROM (
    SELECT DISTINCT wallet FROM adj_six) n LEFT JOIN (SELECT * FROM bfs_six WHERE d <= 4) b ON b.wallet = n.wallet
    GROUP BY 1""")
def _(v):
    return G.distance_to_sources(six(v), v.scam_six_hour, max_depth=4, unreachable=999)


@query("g07_k_hop_neighbors", "SELECT * FROM hops_six")
def _(v):
    return G.k_hop_neighbors(six(v), v.scam_six_hour, 2)


@query("g08_graph_cluster_features", """SELECT a.wallet, neighbor_count, scam_neighbor_count, cluster_size,
    distance AS distance_to_scam FROM (SELECT a.wallet, count(*) AS neighbor_count, count(s.wallet) AS scam_neighbor_count
      FROM adj_six a LEFT JOIN scam_six_hour s ON s.wallet = a.neighbor GROUP BY 1) a
    JOIN comp_six c ON c.wallet = a.wallet
    JOIN (SELECT component, count(*) AS cluster_size FROM comp_six GROUP BY 1) z ON z.component = c.component
    JOIN dist_six d ON d.wallet = a.wallet""")
def _(v):
    return G.graph_cluster_features(six(v), v.scam_six_hour)


SQL_VIEWS["ends_six"] = """SELECT sender AS wallet, receiver AS counterparty, amount_lamports FROM transfers_six_hour
    WHERE sender <> receiver UNION ALL SELECT receiver, sender, amount_lamports FROM transfers_six_hour
    WHERE sender <> receiver"""


@query("g09_cluster_features", f"""SELECT e.wallet, max(cluster_size) AS cluster_size, count(*) AS tx_count,
    count(DISTINCT counterparty) AS unique_counterparties,
    round(sum(amount_lamports) / {D} / count(*) * 1000000) / 1000000 AS avg_tx_value,
    CAST(count(s.wallet) > 0 AS INTEGER) AS is_connected_to_known_scam
    FROM ends_six e JOIN comp_six c ON c.wallet = e.wallet
    JOIN (SELECT component, count(*) AS cluster_size FROM comp_six GROUP BY 1) z ON z.component = c.component
    LEFT JOIN scam_six_hour s ON s.wallet = e.counterparty GROUP BY 1""")
def _(v):
    return G.cluster_features(v.transfers_six_hour, v.scam_six_hour)


def _reach_sql(und: str, scam: str) -> str:
    def step(n, prev, seen):
        return f"""l{n} AS (SELECT source, y AS node, {n} AS depth, arg_min(b.amount, x) AS amount,
            arg_min(b.last_ts, x) AS last_ts FROM {prev} p JOIN both_dir b ON b.x = p.node
            WHERE NOT EXISTS (SELECT 1 FROM ({seen}) q WHERE q.source = p.source AND q.node = b.y) GROUP BY 1, 2)"""

    seen1 = "SELECT source, node FROM l0"
    seen2 = seen1 + " UNION ALL SELECT source, node FROM l1"
    seen3 = seen2 + " UNION ALL SELECT source, node FROM l2"
    return f"""WITH both_dir AS (SELECT a AS x, b AS y, amount, last_ts FROM {und}
        UNION ALL SELECT b, a, amount, last_ts FROM {und}),
        l0 AS (SELECT wallet AS source, wallet AS node FROM {scam}),
        {step(1, 'l0', seen1)}, {step(2, 'l1', seen2)}, {step(3, 'l2', seen3)}
        SELECT * FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) r
        WHERE node NOT IN (SELECT wallet FROM {scam})"""


_PEN = """SELECT node AS wallet, CAST(sum(CAST(CASE depth WHEN 1 THEN -40.0 WHEN 2 THEN -20.0 ELSE -5.0 END
    * least(1.0, log10(amount + 1) / 3) * exp(-(({as_of} - last_ts) / 86400::DOUBLE) / 30.0) AS DECIMAL(28, 9)))
    AS DOUBLE) AS penalty FROM {r} GROUP BY 1"""
SQL_VIEWS["scam_reach"] = _reach_sql("und", "scam_wallets")
SQL_VIEWS["scam_reach_six"] = _reach_sql("und_six", "scam_six_hour")
SQL_VIEWS["scam_pen"] = _PEN.format(as_of=AS_OF, r="scam_reach")
SQL_VIEWS["scam_pen_six"] = _PEN.format(as_of=AS_OF, r="scam_reach_six")


@query("g10_propagate_scam_penalty", "SELECT wallet, round(penalty, 6) AS penalty FROM scam_pen_six")
def _(v):
    return R.propagate_scam_penalty(und_six(v), v.scam_six_hour, AS_OF).withColumn("penalty", F.round("penalty", 6))


@query("g10_propagate_dense", "SELECT wallet, round(penalty, 5) AS penalty FROM scam_pen")
def _(v):
    und = G.undirected_edges(v.transfers, AS_OF)
    return R.propagate_scam_penalty(und, v.scam_wallets, AS_OF).withColumn("penalty", F.round("penalty", 5))


@query("g11_propagation_updates", """SELECT p.wallet, 'SCAM_CLUSTER_MEMBER' AS reason_code,
    CAST(round(penalty) AS INTEGER) AS weight, least(1.0, degree / 10.0)::DOUBLE AS confidence,
    round(greatest(0.0, coalesce(s.score, 50.0) + penalty), 5) AS score FROM scam_pen p
    LEFT JOIN (SELECT w, count(*) AS degree FROM (SELECT a AS w FROM und UNION ALL SELECT b FROM und) GROUP BY 1) d
      ON d.w = p.wallet LEFT JOIN latest_scores s ON s.wallet = p.wallet""")
def _(v):
    und = G.undirected_edges(v.transfers, AS_OF)
    pen = R.propagate_scam_penalty(und, v.scam_wallets, AS_OF)
    deg = G.adjacency(und).groupBy("wallet").agg(F.count(F.lit(1)).alias("degree"))
    return R.propagation_updates(pen, deg, v.latest_scores).withColumn("score", F.round("score", 5))


SQL_VIEWS["hits"] = f"""SELECT source, affected, hop, power(0.5, hop) AS decay, 6 * power(0.5, hop) AS penalty FROM (
    SELECT seed AS source, wallet AS affected, hop FROM ({_HOPS.format(
        s="(SELECT wallet FROM latest_scores WHERE is_anomalous)", a="adj")}))"""


@query("g12_anomalous_neighbor_penalty", """SELECT s.wallet, coalesce(least(20.0, sum(penalty)), 0.0)::DOUBLE AS penalty,
    greatest(0.0, least(100.0, round((s.score - coalesce(least(20.0, sum(penalty)), 0.0))::DOUBLE * 100) / 100))::DOUBLE AS adjusted_score
    FROM latest_scores s LEFT JOIN hits h ON h.affected = s.wallet GROUP BY s.wallet, s.score""")
def _(v):
    s = v.latest_scores
    return R.anomalous_neighbor_penalty(G.transfer_edges(v.transfers), s, s)


@query("g13_propagation_hits", "SELECT source, affected, hop, decay::DOUBLE AS decay, penalty::DOUBLE AS penalty FROM hits")
def _(v):
    return R.propagation_hits(G.transfer_edges(v.transfers), v.latest_scores)


SQL_VIEWS["bidir"] = """SELECT least(x.sender, x.receiver) AS a, greatest(x.sender, x.receiver) AS b FROM edges x
    JOIN edges y ON x.sender = y.receiver AND x.receiver = y.sender WHERE x.sender < x.receiver
    AND x.tx_count >= 2 AND y.tx_count >= 2"""
SQL_VIEWS["bidir_six"] = SQL_VIEWS["bidir"].replace("edges", "edges_six").replace("tx_count >= 2", "tx_count >= 1")


@query("g14_bidirectional_pairs", "SELECT * FROM bidir")
def _(v):
    return R.bidirectional_pairs(G.transfer_edges(v.transfers))


SQL_VIEWS["fund_six"] = """SELECT sender, receiver AS wallet FROM edges_six WHERE sender IN (
    SELECT sender FROM edges_six GROUP BY 1 HAVING count(*) >= 2)"""


@query("g15_shared_funding_sets", "SELECT * FROM fund_six")
def _(v):
    return R.shared_funding_sets(six(v))


@query("g16_fan_out_sets", "SELECT * FROM fund_six UNION SELECT sender, sender FROM fund_six")
def _(v):
    return R.fan_out_sets(six(v))


_BURST = """SELECT bucket, wallet FROM (SELECT last_ts // {w} AS bucket, sender AS wallet FROM {e}
    UNION SELECT last_ts // {w}, receiver FROM {e})
    WHERE bucket IN (SELECT bucket FROM (SELECT last_ts // {w} AS bucket, sender AS wallet FROM {e}
    UNION SELECT last_ts // {w}, receiver FROM {e}) GROUP BY 1 HAVING count(DISTINCT wallet) >= 2)"""


@query("g17_burst_timing_sets", _BURST.format(w=604800, e="edges"))
def _(v):
    return R.burst_timing_sets(G.transfer_edges(v.transfers))


@query("g17_burst_timing_newest", f"""SELECT * FROM ({_BURST.format(w=3600, e="edges_six")})
    QUALIFY dense_rank() OVER (ORDER BY bucket DESC) <= 50""")
def _(v):
    return R.burst_timing_sets(six(v), 3600, max_buckets=50)


# one-hour windows on the six-hour graph: many separate clusters, some with several tags
SQL_VIEWS["burst_six"] = _BURST.format(w=3600, e="edges_six")
SQL_VIEWS["id_rows"] = """SELECT 'bidirectional' AS tag, a || '|' || b AS sid, unnest([a, b]) AS wallet FROM bidir_six
    UNION SELECT 'circular', a || '|' || b, unnest([a, b]) FROM bidir_six
    UNION SELECT 'shared_funding', sender, wallet FROM fund_six UNION SELECT 'fan_in_out', sender, wallet FROM fund_six
    UNION SELECT 'fan_in_out', sender, sender FROM fund_six
    UNION SELECT 'burst_timing', CAST(bucket AS VARCHAR), wallet FROM burst_six"""
SQL_VIEWS["id_links"] = """SELECT DISTINCT hub AS x, wallet AS y FROM id_rows JOIN (
      SELECT tag, sid, min(wallet) AS hub FROM id_rows GROUP BY 1, 2) USING (tag, sid)"""
SQL_VIEWS["id_both"] = "SELECT x, y FROM id_links UNION SELECT y, x FROM id_links"
SQL_VIEWS["id_reach"] = """SELECT DISTINCT wallet AS node, wallet AS root FROM id_rows UNION
    SELECT b.y, r.root FROM id_reach r JOIN id_both b ON b.x = r.node"""
SQL_VIEWS["id_comp"] = "SELECT node AS wallet, min(root) AS cluster_id FROM id_reach GROUP BY 1"


@query("g18_identity_clusters", """SELECT cluster_id, wallet, least(1.0, round((0.4 + 0.1 * n_tags + 0.05 *
      least(size - 2, 4))::DOUBLE * 100) / 100)::DOUBLE AS confidence, tags AS reason_tags, size FROM id_comp JOIN (
    SELECT cluster_id, count(DISTINCT wallet) AS size, count(DISTINCT tag) AS n_tags,
      string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM id_comp JOIN id_rows USING (wallet) GROUP BY 1)
    USING (cluster_id) WHERE size >= 2""")
def _(v):
    cfg = P.ClusterConfig(min_tx=1, window_s=3600)
    return R.identity_clusters(six(v), cfg).withColumn("reason_tags", F.array_join("reason_tags", ","))


SQL_VIEWS["c_risk"] = """SELECT cluster_id, CASE WHEN min(score) IS NULL THEN 0.0 ELSE
    round(least(15.0, (100 - min(score)) * 0.25 + 2.0 * count(*) FILTER (score < 70 OR is_anomalous))::DOUBLE * 100) / 100
    END::DOUBLE AS risk, count(*) FILTER (score < 70 OR is_anomalous) AS risky_count
    FROM cluster_members m LEFT JOIN latest_scores s USING (wallet) GROUP BY 1"""


@query("g19_cluster_risk", "SELECT * FROM c_risk")
def _(v):
    return R.cluster_risk(v.cluster_members, v.latest_scores)


SQL_VIEWS["c_penalized"] = """SELECT s.wallet, greatest(0.0, least(100.0,
    round((s.score - coalesce(least(15.0, r.risk), 0.0))::DOUBLE * 100) / 100))::DOUBLE AS score
    FROM latest_scores s LEFT JOIN cluster_members m USING (wallet) LEFT JOIN c_risk r USING (cluster_id)"""


@query("g20_apply_cluster_penalty", "SELECT * FROM c_penalized")
def _(v):
    return R.apply_cluster_penalty(v.latest_scores, v.cluster_members,
                                   R.cluster_risk(v.cluster_members, v.latest_scores))


SQL_VIEWS["ego_nodes"] = """SELECT seed, e.wallet, hop AS distance, coalesce(s.score, 50.0) AS score,
    b.wallet IS NOT NULL AS is_scam FROM (SELECT * FROM hops_six UNION ALL SELECT wallet, wallet, 0 FROM scam_six_hour) e
    LEFT JOIN latest_scores s ON s.wallet = split_part(e.wallet, '@', 1)
    LEFT JOIN scam_six_hour b ON b.wallet = e.wallet"""
SQL_VIEWS["ego_nearest"] = "SELECT * FROM ego_nodes QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, wallet) <= 20"
EGO_COLOR = """SELECT *, CASE WHEN is_scam THEN 'red' WHEN score >= 80 THEN 'green' WHEN score >= 50 THEN 'yellow' ELSE 'orange' END AS color FROM """
EGO_EDGES = """SELECT x.seed, e.* FROM edges_six e JOIN {0} x ON x.wallet = e.sender JOIN {0} y ON y.wallet = e.receiver AND y.seed = x.seed"""


def _ego(v, max_nodes=None):
    scores = v.transfers_six_hour.select(F.explode(F.array("sender", "receiver")).alias("wallet")).distinct().join(
        v.latest_scores.withColumnRenamed("wallet", "w"), F.split("wallet", "@")[0] == F.col("w")).drop("w")
    return G.ego_graph(v.transfers_six_hour, v.scam_six_hour, scores, v.scam_six_hour, depth=2, max_nodes=max_nodes)


for _k, _name in enumerate(("nodes", "edges")):
    query(f"g21_ego_graph_{_name}", (EGO_COLOR + "ego_nodes", EGO_EDGES.format("ego_nodes"))[_k])(lambda v, k=_k: _ego(v)[k])
    query(f"g21_ego_graph_{_name}_nearest", (EGO_COLOR + "ego_nearest", EGO_EDGES.format("ego_nearest"))[_k])(
        lambda v, k=_k: _ego(v, 20)[k])


@query("g22_cluster_subgraph_nodes", """SELECT cluster_id, wallet, coalesce(score, 50.0) AS score
    FROM cluster_members LEFT JOIN latest_scores USING (wallet)""")
def _(v):
    return G.cluster_subgraph(v.transfers, v.cluster_members, v.latest_scores)[0]


@query("g22_cluster_subgraph_links", """SELECT x.cluster_id, e.sender, e.receiver, e.tx_count FROM edges e
    JOIN cluster_members x ON x.wallet = e.sender JOIN cluster_members y ON y.wallet = e.receiver
    AND y.cluster_id = x.cluster_id""")
def _(v):
    return G.cluster_subgraph(v.transfers, v.cluster_members, v.latest_scores)[1]


@query("g23_simple_paths", """WITH p1 AS (SELECT s.wallet AS source, [s.wallet, e.receiver] AS path, volume AS weight
      FROM scam_six_hour s JOIN edges_six e ON e.sender = s.wallet),
    p2 AS (SELECT source, list_append(path, receiver) AS path, weight + volume AS weight FROM p1
      JOIN edges_six ON sender = path[-1] WHERE NOT list_contains(path, receiver)),
    p3 AS (SELECT source, list_append(path, receiver) AS path, weight + volume AS weight FROM p2
      JOIN edges_six ON sender = path[-1] WHERE NOT list_contains(path, receiver))
    SELECT source, array_to_string(path, '>') AS path, CAST(weight AS BIGINT) AS weight, len(path) - 1 AS depth
    FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)""")
def _(v):
    return G.simple_paths(six(v), v.scam_six_hour).withColumn("path", F.array_join("path", ">"))


@query("g24_log_weighted_edges", f"""SELECT x.cluster_id, least(sender, receiver) AS a, greatest(sender, receiver) AS b,
    round(sum(CAST(ln(amount_lamports / {D} + 1) AS DECIMAL(28, 9))), 6)::DOUBLE AS weight FROM transfers t
    JOIN cluster_members x ON x.wallet = sender JOIN cluster_members y ON y.wallet = receiver
    AND y.cluster_id = x.cluster_id WHERE sender <> receiver GROUP BY 1, 2, 3""")
def _(v):
    return G.log_weighted_edges(v.transfers, v.cluster_members).withColumn("weight", F.round("weight", 6))


SQL_VIEWS["tx_keys"] = """SELECT signature, block_time, wallet, unnest([wallet, supplier]) AS node FROM tx_lines"""
SQL_VIEWS["tx_newest"] = """SELECT wallet, signature FROM tx_heads
    QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY block_time DESC, signature DESC) <= 5"""


@query("g25_neighborhood_cluster", """SELECT wallet, 'cluster_' || substr(sha256(string_agg(node, ' ' ORDER BY node)), 1, 12)
    AS cluster_id, count(*) AS cluster_size, CASE WHEN count(b) > 0 THEN 'HIGH' ELSE 'LOW' END AS cluster_risk
    FROM (SELECT DISTINCT k.wallet, k.node, s.wallet AS b FROM tx_keys k LEFT JOIN scam_suppliers s ON s.wallet = k.node
      WHERE k.node = k.wallet OR length(k.node) BETWEEN 3 AND 48) GROUP BY 1""")
def _(v):
    return G.neighborhood_cluster(v.tx_raw, v.scam_suppliers, ["transfer-program"], min_len=3)


@query("g25_neighborhood_cluster_newest", """SELECT wallet, count(*) AS cluster_size, CASE WHEN count(b) > 0 THEN 'HIGH' ELSE 'LOW' END AS cluster_risk
    FROM (SELECT DISTINCT k.wallet, k.node, s.wallet AS b FROM tx_keys k JOIN tx_newest n ON n.signature = k.signature
      LEFT JOIN scam_suppliers s ON s.wallet = k.node WHERE k.node = k.wallet OR length(k.node) BETWEEN 3 AND 48) GROUP BY 1""")
def _(v):
    return G.neighborhood_cluster(v.tx_raw, v.scam_suppliers, ["transfer-program"], n=5, min_len=3).drop("cluster_id")


SQL_VIEWS["sus_tx"] = """SELECT wallet, count(*) FILTER (wallet IN (FROM scam_wallets) OR counterparty IN (FROM scam_wallets))
    AS n FROM ends GROUP BY 1"""


@query("g26_suspicious_tx_count", "SELECT * FROM sus_tx")
def _(v):
    return G.suspicious_tx_count(v.transfers, v.scam_wallets)


SQL_VIEWS["to_scam"] = f"""SELECT sender AS wallet, count(*) AS tx_count, sum(amount_lamports) / {D} AS sol FROM transfers
    WHERE receiver IN (FROM scam_wallets) GROUP BY 1"""


@query("g27_flow_to_scam", "SELECT wallet, tx_count, round(sol, 6) AS sol FROM to_scam")
def _(v):
    return G.flow_to_scam(v.transfers, v.scam_wallets).withColumn("sol", F.round("sol", 6))


SQL_VIEWS["c_ratio"] = """SELECT cluster_id, count(*) AS size, round(count(s.wallet)::DOUBLE / count(*) * 100) / 100 AS scam_ratio
    FROM cluster_members m LEFT JOIN scam_wallets s USING (wallet) GROUP BY 1"""


@query("g28_cluster_scam_ratio", "SELECT * FROM c_ratio")
def _(v):
    return G.cluster_scam_ratio(v.cluster_members, v.scam_wallets)
