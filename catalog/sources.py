"""Source parsing over transactions derived from orders and events."""

import uuid

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import AS_OF, SQL_VIEWS
from ledgerwise.functions.storage import shared_dir
from ledgerwise.sources import tables as T
from ledgerwise.sources import transactions as X

MID = AS_OF - 15 * 86_400


@query("s01_read_wallet_csv", "SELECT wallet FROM wallets")
def _(v):
    """Every sender and receiver, padded and repeated, written as CSV and read back."""
    path = f"{shared_dir(v.spark)}/csv-{uuid.uuid4().hex}"
    t = v.transfers
    names = t.select(F.concat(F.lit(" "), F.col("sender")).alias("address"), "program_id").union(t.select("receiver", "program_id"))
    T.write_table(names, path, "csv")
    return T.read_wallet_csv(v.spark, path)


@query("s17_write_table", "SELECT signature, wallet, amount_lamports, program_id FROM transfers")
def _(v):
    path = f"{shared_dir(v.spark)}/table-{uuid.uuid4().hex}"
    T.write_table(v.transfers, path, "parquet", partition_by=["program_id"])
    return v.spark.read.parquet(path).select("signature", "wallet", "amount_lamports", "program_id")


@query("s02_transfers_from_enriched", f"""SELECT 'E' || event_id AS signature, 'W' || user_id AS sender, 'W' || k AS receiver,
    CASE WHEN event_type = 'purchase' THEN round(value * 100) / CAST(100 AS DOUBLE) WHEN event_type = 'click' THEN value ELSE
      round(value * CAST(1e9 AS DOUBLE)) / CAST(1e9 AS DOUBLE) END AS amount,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'M' || k ELSE 'SOL' END AS token, ts,
    CASE WHEN event_type = 'signup' THEN '{X.SYSTEM_PROGRAM}' WHEN event_type = 'purchase' THEN '{X.TOKEN_PROGRAM}'
      ELSE event_type END AS program_id FROM ev""")
def _(v):
    e = F.col("event_type")
    ends = [F.concat(F.lit("W"), F.col("user_id")).alias("fromUserAccount"),
            F.concat(F.lit("W"), F.col("k")).alias("toUserAccount")]
    lamports = F.round(F.col("value") * 1e9).cast("long")
    blank = F.struct(F.lit("").alias("fromUserAccount"), F.lit("x").alias("toUserAccount"),
                     F.lit(None).cast("bigint").alias("amount"))
    native = F.when(~e.isin("purchase", "click"), F.array(blank, F.struct(*ends, lamports.alias("amount"))))
    cents = F.round(F.col("value") * 100).cast("long")
    nested = F.struct(F.struct(cents.cast("string").alias("amount"), F.lit(2).alias("decimals")).alias("tokenAmount"),
                      *ends, F.concat(F.lit("M"), F.col("k")).alias("mint"))
    plain = F.struct(F.col("value").alias("amount"), *ends, F.concat(F.lit("M"), F.col("k")).alias("tokenMint"))
    raw = v.ev.select(F.to_json(F.struct(
        F.when(e != "view", F.concat(F.lit("E"), F.col("event_id"))).alias("signature"),
        F.when(e == "view", F.concat(F.lit("E"), F.col("event_id"))).alias("txHash"),
        F.col("ts").alias("timestamp"),
        F.when(~e.isin("signup", "purchase"), F.array(F.struct(e.alias("programId")))).alias("instructions"),
        native.alias("nativeTransfers"),
    )).alias("a"), F.to_json(F.struct(F.array(nested).alias("tokenTransfers"))).alias("b"),
        F.to_json(F.struct(F.array(plain).alias("tokenTransfers"))).alias("c"), "event_type")
    tail = F.when(e == "purchase", F.col("b")).when(e == "click", F.col("c"))
    joined = F.when(tail.isNull(), F.col("a")).otherwise(
        F.concat(F.expr("substring(a, 1, length(a) - 1)"), F.lit(","), F.substring(tail, 2, 10_000)))
    return X.transfers_from_enriched(raw.select(joined.alias("raw")))


@query("s03_transfers_from_instructions", """SELECT signature, wallet AS sender, supplier AS receiver, lamports,
    block_time AS ts, slot FROM tx_lines""")
def _(v):
    return X.transfers_from_instructions(v.tx_raw)


@query("s04_edges_from_instructions", "SELECT DISTINCT wallet AS sender, supplier AS receiver FROM tx_lines")
def _(v):
    return X.edges_from_instructions(v.tx_raw)


SQL_VIEWS["tx_gain"] = """SELECT signature, wallet, supplier, block_time, slot, CAST(sum(lamports) AS BIGINT) AS gain
    FROM tx_lines GROUP BY ALL"""


@query("s05_transfers_from_balance_delta", """SELECT signature, wallet AS sender, supplier AS receiver, gain AS lamports,
    block_time AS ts, slot FROM tx_gain QUALIFY row_number() OVER (PARTITION BY signature ORDER BY gain DESC, supplier) = 1""")
def _(v):
    return X.transfers_from_balance_delta(v.tx_raw)


@query("s06_balance_change", """SELECT signature, supplier AS wallet, gain AS delta_lamports, block_time AS ts FROM tx_gain
    UNION ALL SELECT signature, wallet, CAST(-sum(gain) - 10000 AS BIGINT), block_time FROM tx_gain GROUP BY 1, 2, 4""")
def _(v):
    t = v.transfers_large
    return X.balance_change(v.tx_raw, t.select("wallet").union(t.select("receiver")))


@query("s07_tx_programs", """SELECT signature, string_agg(DISTINCT p, ',' ORDER BY p) AS programs FROM (
    SELECT signature, program_id AS p FROM tx_lines UNION ALL
    SELECT signature, 'inner-' || l_returnflag FROM tx_lines QUALIFY row_number() OVER (
      PARTITION BY signature ORDER BY l_linenumber, l_suppkey, l_partkey, lamports) = 1) GROUP BY 1""")
def _(v):
    return X.tx_programs(v.tx_raw).withColumn("programs", F.array_join(F.array_sort("programs"), ","))


@query("s08_normalize_transfers", """SELECT signature, sender, receiver, ts, amount_lamports / CAST(1e9 AS DOUBLE) AS amount_sol
    FROM transfers WHERE program_id <> 'view'""")
def _(v):
    other = v.transfers.select(
        "signature", F.concat(F.lit(" "), F.col("sender")).alias("from_wallet"),
        F.when(F.col("program_id") == "view", F.lit("  ")).otherwise(F.col("receiver")).alias("to_wallet"),
        (F.col("amount_lamports") / 1e9).alias("amount"), F.col("ts").alias("timestamp"))
    return T.normalize_transfers(other, "explorer").select("signature", "sender", "receiver", "ts", "amount_sol")


@query("s09_incremental_append", f"""SELECT wallet, signature FROM transfers WHERE ts > {MID}""")
def _(v):
    t = v.transfers
    old = t.filter(F.col("ts") <= MID)
    return T.incremental_append(old, t.union(t), ["wallet", "signature"])[0].select("wallet", "signature")


@query("s10_upsert_by_key", f"""WITH old AS (SELECT wallet, min(score) AS score FROM score_timeline WHERE computed_at <= {MID}
      GROUP BY 1), new AS (SELECT wallet, max(score) AS score FROM score_timeline WHERE computed_at > {AS_OF - 2 * 86400}
      GROUP BY 1) SELECT * FROM new UNION ALL SELECT * FROM old WHERE wallet NOT IN (SELECT wallet FROM new)""")
def _(v):
    s = v.score_timeline
    old = s.filter(F.col("computed_at") <= MID).groupBy("wallet").agg(F.min("score").alias("score"))
    new = s.filter(F.col("computed_at") > AS_OF - 2 * 86_400).groupBy("wallet").agg(F.max("score").alias("score"))
    return T.upsert_by_key(old, new, ["wallet"])


@query("s11_recent_history", "SELECT wallet, signature, ts FROM transfers_large")
def _(v):
    return T.recent_history(v.transfers_large).select("wallet", "signature", "ts")


@query("s11_recent_history_newest", """SELECT wallet, signature, ts FROM transfers
    QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, signature DESC) <= 50""")
def _(v):
    return T.recent_history(v.transfers, 50).select("wallet", "signature", "ts")


@query("s11_recent_history_until", f"""SELECT wallet, signature, ts FROM transfers_large WHERE ts <= {AS_OF}
    QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, signature DESC) <= 20""")
def _(v):
    return T.recent_history(v.transfers_large, 20, until=AS_OF).select("wallet", "signature", "ts")


@query("s12_days_back_filter", f"SELECT signature, ts FROM transfers WHERE ts >= {AS_OF - 7 * 86400}")
def _(v):
    return T.days_back_filter(v.transfers, AS_OF, 7).select("signature", "ts")


@query("s13_valid_address", f"""SELECT wallet, regexp_matches(rpad(wallet, 32, 'A'), '{T.ADDRESS_PATTERN}') AS valid
    FROM wallets""")
def _(v):
    return v.wallets.select("wallet", T.valid_address(F.rpad("wallet", 32, "A")).alias("valid"))


def _csv_rows(v):
    return v.transfers.select(F.concat(F.lit(" "), F.rpad("sender", 32, "A")).alias("wallet"),
                              F.when(F.col("program_id") != "view", F.col("program_id")).alias("label"))


SQL_VIEWS["csv_status"] = f"""SELECT c.wallet, CASE WHEN NOT regexp_matches(c.wallet, '{T.ADDRESS_PATTERN}') THEN 'invalid'
    WHEN s.wallet IS NOT NULL THEN 'duplicate' ELSE 'imported' END AS status, n, empty_labels FROM (
      SELECT rpad(sender, 32, 'A') AS wallet, count(*) AS n, count(*) FILTER (program_id = 'view') AS empty_labels
      FROM transfers GROUP BY 1) c LEFT JOIN (SELECT rpad(wallet, 32, 'A') AS wallet FROM scam_wallets) s USING (wallet)"""


def _import(v):
    return T.import_wallets(_csv_rows(v), v.scam_wallets.select(F.rpad("wallet", 32, "A").alias("wallet")))


@query("s14_import_wallets", "SELECT * FROM csv_status")
def _(v):
    return _import(v)


@query("s14_import_report", """SELECT count(*) FILTER (status = 'imported') AS imported,
    CAST(coalesce(sum(n - (status = 'imported')::INT) FILTER (status <> 'invalid'), 0) AS BIGINT) AS duplicates,
    CAST(coalesce(sum(n) FILTER (status = 'invalid'), 0) AS BIGINT) AS invalid,
    CAST(sum(empty_labels) AS BIGINT) AS empty_labels FROM csv_status""")
def _(v):
    return T.import_report(_import(v))


@query("s15_flatten_tokens", """SELECT mint, trim(name) AS name, symbol, mint_authority, freeze_authority, nullif(supply, 0) AS supply, decimals,
    CASE WHEN metadata_missing THEN creator_wallets[1] ELSE array_to_string(creator_wallets, ';') END AS creator_wallets,
    mint_authority IS NOT NULL AS mint_authority_exists, freeze_authority IS NOT NULL AS freeze_authority_exists,
    metadata_missing FROM (SELECT * REPLACE (CASE WHEN NOT metadata_missing THEN name END AS name,
      CASE WHEN NOT metadata_missing THEN symbol END AS symbol) FROM tokens)""")
def _(v):
    t = v.tokens
    cw = F.col("creator_wallets")
    meta = F.when(~F.col("metadata_missing"), F.struct(
        F.concat(F.lit(" "), F.col("name")).alias("name"), "symbol",
        F.transform(cw, lambda c: F.struct(c.alias("address"))).alias("creators")))
    auth = F.array(
        F.struct(F.lit("mint").alias("type"), F.col("mint_authority").alias("address")),
        F.struct(F.lit("owner").alias("type"), cw[0].alias("address")))
    raw = t.select(F.to_json(F.struct(
        F.col("mint").alias("id"), F.struct(meta.alias("metadata")).alias("content"), auth.alias("authorities"),
        F.struct("supply", F.col("freeze_authority").alias("freezeAuthority")).alias("token_info"), "decimals",
    )).alias("raw"))
    return X.flatten_tokens(raw).withColumn("creator_wallets", F.array_join("creator_wallets", ";"))


@query("s16_parse_list_column", """SELECT mint, unnest(creator_wallets) AS creator FROM tokens""")
def _(v):
    c = F.col("creator_wallets")
    text = (F.when(F.col("decimals") == 0, F.to_json(c))
            .when(F.col("metadata_missing"), F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']")))
            .otherwise(F.concat(F.array_join(c, " ; "), F.lit(","))))
    return v.tokens.select("mint", F.explode(T.parse_list_column(text)).alias("creator"))


@query("s18_distinct_owners", "SELECT DISTINCT mint, wallet AS owner FROM token_accounts")
def _(v):
    return T.distinct_owners(v.counted_accounts())


@query("s18_distinct_owners_first", """SELECT DISTINCT mint, wallet AS owner FROM token_accounts
    QUALIFY row_number() OVER (PARTITION BY mint ORDER BY wallet) <= 10""")
def _(v):
    return T.distinct_owners(v.counted_accounts(), 10)
