"""Driver tables mapped to the canonical schemas, in Spark and in SQL."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise import params as P
from ledgerwise.functions.common import lookup, rnd
from ledgerwise.functions.storage import shared_dir, write_step

AS_OF = 1_706_659_200  # end of the event month
AS_OF_ORDERS = 1_009_843_200  # end of the order years
DAY = 86_400

EVENT_CODES = {
    "error": "DRAINER_INTERACTION",
    "signup": "NEW_WALLET",
    "purchase": "HIGH_VALUE_OUTFLOW",
    "click": "LOW_ACTIVITY",
    "view": "CLEAN_HISTORY",
}


def micros(c: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


_ingested: dict[tuple[str, str, str], str] = {}

#: Bytes of a table file that one task of a shuffle of the table takes.
PART_BYTES = 8 << 20


class Views:
    """Canonical tables.  The first query of a session that needs one writes it to the shared
    folder, as an ingestion job would; later queries read the columns they need from it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def parts(self, name: str) -> int:
        """Partitions for a shuffle of a whole table: bounded in bytes, whatever the session's setting."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}.parquet")
        size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return max(self.spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows of a scan over all cores.  Only for plans without a shuffle: asking others for their partitions runs them."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def ingested(self, name: str, df: DataFrame) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _ingested:
            path = f"{shared_dir(self.spark)}/ingest-{uuid.uuid4().hex}/{name}"
            write_step(df, path)
            _ingested[key] = path
        return self.spark.read.schema(df.schema).parquet(_ingested[key])

    @cached_property
    def ev(self) -> DataFrame:
        return self.ingested("events", self.spread(self.raw_events()))

    def raw_events(self) -> DataFrame:
        us = micros("ts")
        return self.table("events").select(
            "event_id", "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"),
            F.floor(us / 1_000_000).alias("ts"),
            F.floor(us * 5 / 2_000_000).alias("slot"),
        )

    @cached_property
    def transfers(self) -> DataFrame:
        return self.ingested("transfers", self.spread(self.event_transfers()))

    def event_transfers(self) -> DataFrame:
        w = F.concat(F.lit("W"), F.col("user_id"))
        return self.ev.select(
            F.concat(F.lit("E"), F.col("event_id")).alias("signature"),
            w.alias("wallet"), w.alias("sender"),
            F.concat(F.lit("W"), F.col("k")).alias("receiver"),
            F.round(F.col("value") * 1e9).cast("long").alias("amount_lamports"),
            "ts", "slot", F.col("event_type").alias("program_id"), F.lit("SOL").alias("token"),
            F.when(F.col("event_type") == "error", "err").alias("err"),
        )

    @cached_property
    def transfers_six_hour(self) -> DataFrame:
        """Wallets split by six-hour period: many small components and longer distances."""
        period = F.concat(F.lit("@"), F.floor(F.col("ts") / 21_600).cast("string"))
        return self.ingested("transfers_six_hour", self.spread(self.transfers.withColumns({
            "sender": F.concat("sender", period), "receiver": F.concat("receiver", period),
            "wallet": F.concat("wallet", period),
        })))

    @cached_property
    def transfers_large(self) -> DataFrame:
        n = self.parts("lineitem")
        li = self.table("lineitem").repartition(n, "l_orderkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
        return self.ingested("transfers_large", li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat(F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("signature"),
            F.concat(F.lit("C"), F.col("o_custkey")).alias("wallet"),
            F.concat(F.lit("C"), F.col("o_custkey")).alias("sender"),
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("receiver"),
            F.round(F.col("l_extendedprice") * 1e9).cast("long").alias("amount_lamports"),
            F.floor(micros("l_shipdate") / 1_000_000).alias("ts"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("slot"),
            F.concat("l_returnflag", "l_linestatus").alias("program_id"),
            F.concat(F.lit("P"), F.col("l_partkey")).alias("token"),
            F.lit(None).cast("string").alias("err"),
        ))

    @cached_property
    def scam_events(self) -> DataFrame:
        """Error events of at least 60 % of the largest one."""
        errors = self.transfers_six_hour.filter(F.col("program_id") == "error")
        top = errors.agg(F.max("amount_lamports").alias("top"))
        return errors.join(F.broadcast(top), F.col("amount_lamports") * 10 >= F.col("top") * 6)

    @cached_property
    def scam_wallets(self) -> DataFrame:
        return self.scam_events.select(F.split("sender", "@")[0].alias("wallet")).distinct()

    @cached_property
    def scam_six_hour(self) -> DataFrame:
        return self.scam_events.select(F.col("sender").alias("wallet")).distinct()

    @cached_property
    def scam_suppliers(self) -> DataFrame:
        return self.table("supplier").filter("s_acctbal < 0").select(
            F.concat(F.lit("S"), F.col("s_suppkey")).alias("wallet")
        )

    @cached_property
    def wallets(self) -> DataFrame:
        t = self.transfers
        return t.select(F.col("sender").alias("wallet")).union(t.select("receiver")).distinct()

    @cached_property
    def score_timeline(self) -> DataFrame:
        return self.ev.select(
            F.concat(F.lit("W"), F.col("user_id")).alias("wallet"),
            rnd(F.greatest(F.lit(0.0), 100 - F.col("value")), 2).alias("score"),
            F.col("ts").alias("computed_at"), F.col("event_id").alias("id"),
            (F.col("event_type") == "error").alias("is_anomalous"),
        )

    @cached_property
    def latest_scores(self) -> DataFrame:
        newest = F.struct("computed_at", "id")
        return self.score_timeline.groupBy("wallet").agg(
            F.max_by("score", newest).alias("score"), F.max("computed_at").alias("computed_at"),
            F.max_by("is_anomalous", newest).alias("is_anomalous"),
        )

    @cached_property
    def wallet_reasons(self) -> DataFrame:
        code = (
            F.when((F.col("event_type") == "error") & (F.col("value") >= 100), "SCAM_CLUSTER_MEMBER")
            .when((F.col("event_type") == "purchase") & (F.col("value") >= 150), "RUG_PULL_DEPLOYER")
            .otherwise(lookup(EVENT_CODES, F.col("event_type")))
        )
        return self.ev.select(
            F.concat(F.lit("W"), F.col("user_id")).alias("wallet"), code.alias("reason_code"),
            lookup(P.REASON_WEIGHTS, code).alias("weight"),
            F.when(F.col("event_type") != "view", F.least(F.lit(1.0), F.col("value") / 100)).alias("confidence"),
            F.concat(F.lit("E"), F.col("event_id")).alias("tx_hash"), F.col("ts").alias("created_at"),
        )

    @cached_property
    def reason_evidence(self) -> DataFrame:
        return self.transfers.select(
            "wallet", lookup(EVENT_CODES, F.col("program_id")).alias("reason_code"),
            F.col("signature").alias("tx_signature"), F.col("receiver").alias("counterparty"),
            F.col("ts").alias("timestamp"), F.lit(1.0).alias("confidence"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        severity = (
            F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 50, "high").otherwise("medium")
        )
        return self.ev.filter("event_type = 'error'").select(
            F.concat(F.lit("W"), F.col("user_id")).alias("wallet"), severity.alias("severity"),
            F.concat(F.lit("burst "), severity).alias("reason"), F.col("ts").alias("created_at"),
        )

    @cached_property
    def cluster_members(self) -> DataFrame:
        """Senders grouped by the receiver of their first transfer."""
        return self.ev.groupBy(F.concat(F.lit("W"), F.col("user_id")).alias("wallet")).agg(
            F.min_by("k", F.struct("ts", "event_id")).alias("cluster_id")
        )

    @cached_property
    def usage_events(self) -> DataFrame:
        return self.ev.select(
            F.col("user_id").cast("string").alias("api_key"), F.col("event_type").alias("endpoint"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
            F.col("value").alias("response_ms"), "ts",
        )

    @cached_property
    def stage_log(self) -> DataFrame:
        return self.ev.select(
            "ts", F.col("event_type").alias("stage"),
            F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
            F.concat(F.lit("run "), F.col("event_id")).alias("message"),
            F.round(F.col("value")).alias("latency_ms"), F.concat(F.lit("W"), F.col("user_id")).alias("wallet"),
        )

    @cached_property
    def tracked_wallets(self) -> DataFrame:
        """Wallets with a tier by how many transfers they sent, and the time of the last one before the final day."""
        sent = self.transfers.groupBy(F.col("sender").alias("wallet")).agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(F.col("ts") < AS_OF - 2 * DAY, F.col("ts"))).alias("last_scan_ts"),
        )
        return self.wallets.join(sent, "wallet", "left").select(
            "wallet", F.when(F.col("n") >= 75, "critical").when(F.col("n") >= 65, "watchlist")
            .otherwise("normal").alias("tier"), "last_scan_ts",
        )

    @cached_property
    def tokens(self) -> DataFrame:
        sup = lambda m: F.concat(F.lit("S"), (F.col("p_partkey") % m).cast("string"))
        return self.table("part").select(
            F.concat(F.lit("P"), F.col("p_partkey")).alias("mint"), F.col("p_name").alias("name"),
            F.col("p_brand").alias("symbol"),
            F.when(F.col("p_size") % 5 == 0, sup(100)).alias("mint_authority"),
            F.when(F.col("p_size") % 7 == 0, sup(100)).alias("freeze_authority"),
            (F.col("p_partkey") * 1000).alias("supply"),
            F.when(F.col("p_size") < 10, 0).otherwise(6).alias("decimals"),
            (F.col("p_partkey") % 11 == 0).alias("metadata_missing"),
            F.array(sup(90), F.concat(F.lit("C"), F.col("p_partkey"))).alias("creator_wallets"),
            F.col("p_type").alias("collection"),
        )

    @cached_property
    def token_accounts(self) -> DataFrame:
        return self.ingested("token_accounts", self.counted_accounts())

    def counted_accounts(self) -> DataFrame:
        rows = self.transfers_large.select("wallet", F.col("token").alias("mint"))
        held = rows.repartition(self.parts("lineitem"), "wallet", "mint").groupBy("wallet", "mint").agg(
            F.count(F.lit(1)).alias("amount")
        )
        return held.join(self.tokens.select("mint", "decimals"), "mint")

    @cached_property
    def tx_raw(self) -> DataFrame:
        """One transaction per order: the customer pays each supplier once per line."""
        fee = 5000
        # names are put together once per line, not in every list made of the lines
        line = F.struct("l_linenumber", "l_suppkey", "l_partkey", "lamports", "l_returnflag", "l_linestatus",
                        F.concat(F.lit("S"), "l_suppkey").alias("supplier"), F.concat(F.lit("P"), "l_partkey").alias("mint"),
                        F.concat("l_returnflag", "l_linestatus").alias("program"))
        n = self.parts("lineitem")  # lines and orders are shuffled once, to the same tasks, and collected there
        li = self.table("lineitem").withColumn("lamports", F.round(F.col("l_extendedprice") * 1e9).cast("long"))
        per_order = li.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("ls"))
        customer = F.concat(F.lit("C"), F.col("o_custkey"))
        o = self.table("orders").repartition(n, "o_orderkey").withColumn("customer", customer).join(
            per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        customer = F.col("customer")
        suppliers = F.expr("array_sort(array_distinct(transform(ls, x -> x.supplier)))")
        total = F.expr("aggregate(ls, 0L, (a, x) -> a + x.lamports)")
        got = ("aggregate(filter(ls, x -> x.supplier = s), 0L, (a, x) -> a + x.lamports)")
        ins = ("transform(ls, x -> named_struct('program_id', x.program, 'type', 'transfer', 'source', customer, "
               "'destination', x.supplier, 'lamports', x.lamports))")
        bal = ("transform(ls, (x, i) -> named_struct('account_index', i, 'mint', x.mint, 'owner', customer, "
               "'ui_amount', {}))")
        return self.ingested("tx_raw", o.withColumn("sup", suppliers).select(
            F.concat(F.lit("O"), F.col("o_orderkey")).alias("signature"),
            F.floor(micros("o_orderdate") / 1_000_000).alias("block_time"), F.col("o_orderkey").alias("slot"),
            customer.alias("wallet"),
            F.concat(F.array(customer), F.col("sup"), F.array(F.lit("transfer-program"))).alias("account_keys"),
            F.expr(ins).alias("instructions"),
            F.expr("transform(slice(ls, 1, 1), x -> named_struct('program_id', concat('inner-', x.l_returnflag)))")
            .alias("inner_instructions"),
            F.expr("concat(array(1000000000000000L), transform(sup, s -> 0L), array(1L))").alias("pre_balances"),
            F.concat(
                F.array(F.lit(1_000_000_000_000_000) - total - fee),
                F.expr(f"transform(sup, s -> {got})"), F.array(F.lit(1)),
            ).cast("array<bigint>").alias("post_balances"),
            F.lit(fee).cast("long").alias("fee"), F.lit(1).alias("required_signatures"),
            F.when(F.col("o_orderstatus") == "P", "failed").alias("err"),
            F.concat(F.lit("order "), F.when(F.col("o_orderpriority").startswith("1"), "rug pull")
                     .otherwise(F.col("o_orderpriority"))).alias("description"),
            F.when(F.col("o_orderstatus") == "F", "TOKEN_MINT").otherwise("TRANSFER").alias("type"),
            F.expr(bal.format("1.0D")).alias("token_balances_pre"),
            F.expr(bal.format("if(x.l_returnflag = 'R', 0.0D, 1.0D)")).alias("token_balances_post"),
        ))


    @cached_property
    def scam_programs(self) -> DataFrame:
        """Program codes of the lines with the highest tax."""
        li = self.table("lineitem")
        top = li.agg(F.max("l_tax").alias("m"))
        return li.join(F.broadcast(top), F.col("l_tax") >= F.col("m")).filter("l_linestatus = 'O'").select(
            F.concat("l_returnflag", "l_linestatus").alias("program_id")).distinct()

    @cached_property
    def scam_tokens(self) -> DataFrame:
        return self.tokens.filter("mint_authority IS NOT NULL AND freeze_authority IS NOT NULL").select("mint")

    @cached_property
    def scam_collections(self) -> DataFrame:
        return self.tokens.filter("collection LIKE 'P%'").select("collection").distinct()

    @cached_property
    def lists(self):
        from ledgerwise.plans.wallet_analysis import Blacklists

        return Blacklists(self.scam_suppliers, self.scam_programs, self.scam_tokens, self.scam_collections,
                          dex=["RF"], lp=["AF", "inner-N"], known_programs=["transfer-program"])


def _case(mapping: dict, col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _num_case(mapping: dict, col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + " END"


SQL_VIEWS: dict[str, str] = {
    "ev": """SELECT event_id, user_id, event_type, value,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        epoch_us(ts) // 1000000 AS ts, (epoch_us(ts) * 5) // 2000000 AS slot FROM events""",
    "transfers": """SELECT 'E' || event_id AS signature, 'W' || user_id AS wallet, 'W' || user_id AS sender,
        'W' || k AS receiver, CAST(round(value * 1e9) AS BIGINT) AS amount_lamports, ts, slot,
        event_type AS program_id, 'SOL' AS token, CASE WHEN event_type = 'error' THEN 'err' END AS err FROM ev""",
    "transfers_six_hour": """SELECT signature, wallet || '@' || (ts // 21600) AS wallet,
        sender || '@' || (ts // 21600) AS sender, receiver || '@' || (ts // 21600) AS receiver,
        amount_lamports, ts, slot, program_id, token, err FROM transfers""",
    "transfers_large": """SELECT l_orderkey || '-' || l_linenumber AS signature, 'C' || o_custkey AS wallet,
        'C' || o_custkey AS sender, 'S' || l_suppkey AS receiver,
        CAST(round(l_extendedprice * 1e9) AS BIGINT) AS amount_lamports, epoch_us(l_shipdate) // 1000000 AS ts,
        l_orderkey * 8 + l_linenumber AS slot, l_returnflag || l_linestatus AS program_id,
        'P' || l_partkey AS token, CAST(NULL AS VARCHAR) AS err
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "scam_events": """SELECT t.* FROM transfers_six_hour t WHERE program_id = 'error' AND amount_lamports * 10 >=
        6 * (SELECT max(amount_lamports) FROM transfers_six_hour WHERE program_id = 'error')""",
    "scam_wallets": "SELECT DISTINCT split_part(sender, '@', 1) AS wallet FROM scam_events",
    "scam_six_hour": "SELECT DISTINCT sender AS wallet FROM scam_events",
    "scam_suppliers": "SELECT 'S' || s_suppkey AS wallet FROM supplier WHERE s_acctbal < 0",
    "wallets": "SELECT sender AS wallet FROM transfers UNION SELECT receiver FROM transfers",
    "score_timeline": """SELECT 'W' || user_id AS wallet, round(greatest(0.0, 100 - value) * 100) / 100 AS score,
        ts AS computed_at, event_id AS id, event_type = 'error' AS is_anomalous FROM ev""",
    "latest_scores": """SELECT wallet, score, computed_at, is_anomalous FROM score_timeline
        QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY computed_at DESC, id DESC) = 1""",
    "wallet_reasons": f"""SELECT 'W' || user_id AS wallet, code AS reason_code,
        {_num_case(P.REASON_WEIGHTS, 'code')} AS weight,
        CASE WHEN event_type <> 'view' THEN least(1.0, value / 100) END AS confidence,
        'E' || event_id AS tx_hash, ts AS created_at
        FROM (SELECT *, CASE WHEN event_type = 'error' AND value >= 100 THEN 'SCAM_CLUSTER_MEMBER'
              WHEN event_type = 'purchase' AND value >= 150 THEN 'RUG_PULL_DEPLOYER'
              ELSE {_case(EVENT_CODES, 'event_type')} END AS code FROM ev)""",
    "reason_evidence": f"""SELECT wallet, {_case(EVENT_CODES, 'program_id')} AS reason_code,
        signature AS tx_signature, receiver AS counterparty, ts AS "timestamp", 1.0 AS confidence FROM transfers""",
    "alerts": """SELECT wallet, severity, 'burst ' || severity AS reason, created_at FROM (
        SELECT 'W' || user_id AS wallet, CASE WHEN value >= 100 THEN 'critical' WHEN value >= 50 THEN 'high'
        ELSE 'medium' END AS severity, ts AS created_at FROM ev WHERE event_type = 'error')""",
    "cluster_members": """SELECT 'W' || user_id AS wallet, k AS cluster_id FROM ev
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
    "usage_events": """SELECT CAST(user_id AS VARCHAR) AS api_key, event_type AS endpoint,
        CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS response_ms, ts FROM ev""",
    "stage_log": """SELECT ts, event_type AS stage, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
        'run ' || event_id AS message, round(value) AS latency_ms, 'W' || user_id AS wallet FROM ev""",
    "tracked_wallets": f"""SELECT w.wallet, CASE WHEN n >= 75 THEN 'critical' WHEN n >= 65 THEN 'watchlist'
        ELSE 'normal' END AS tier, last_scan_ts FROM wallets w LEFT JOIN (
        SELECT sender AS wallet, count(*) AS n,
          max(CASE WHEN ts < {AS_OF - 2 * DAY} THEN ts END) AS last_scan_ts
        FROM transfers GROUP BY 1) s ON s.wallet = w.wallet""",
    "tokens": """SELECT 'P' || p_partkey AS mint, p_name AS name, p_brand AS symbol,
        CASE WHEN p_size % 5 = 0 THEN 'S' || (p_partkey % 100) END AS mint_authority,
        CASE WHEN p_size % 7 = 0 THEN 'S' || (p_partkey % 100) END AS freeze_authority,
        p_partkey * 1000 AS supply, CASE WHEN p_size < 10 THEN 0 ELSE 6 END AS decimals,
        p_partkey % 11 = 0 AS metadata_missing, ['S' || (p_partkey % 90), 'C' || p_partkey] AS creator_wallets,
        p_type AS collection FROM part""",
    "token_accounts": """SELECT h.wallet, h.mint, h.amount, t.decimals FROM (
        SELECT wallet, token AS mint, count(*) AS amount FROM transfers_large GROUP BY 1, 2) h JOIN tokens t USING (mint)""",
    "tx_lines": """SELECT 'O' || l_orderkey AS signature, epoch_us(o_orderdate) // 1000000 AS block_time,
        o_orderkey AS slot, 'C' || o_custkey AS wallet, 'S' || l_suppkey AS supplier, 'P' || l_partkey AS mint, l_suppkey, l_partkey,
        CAST(round(l_extendedprice * 1e9) AS BIGINT) AS lamports, l_linenumber, l_returnflag, l_linestatus,
        o_orderstatus, o_orderpriority,
        l_returnflag || l_linestatus AS program_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "tx_heads": """SELECT DISTINCT signature, block_time, slot, wallet, o_orderstatus, o_orderpriority FROM tx_lines""",
}

