"""Raw transactions to transfers, edges, balance changes and program sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions.common import LAMPORTS_PER_SOL, clean_wallet, join_skewed
from ledgerwise.functions.storage import cut_lineage
from ledgerwise.schemas import ASSET, ENRICHED_TX

SYSTEM_PROGRAM = "11111111111111111111111111111111"
TOKEN_PROGRAM = "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA"
#: Rows of accounts that one task sorts in a join by account.
TASK_ROWS = 500_000


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def transfers_from_enriched(raw: DataFrame, col: str = "raw") -> DataFrame:
    """First native transfer of each enriched JSON transaction, else its first token transfer."""
    # a generated column: filters on it are not pushed below the parser, which would parse the text once per use
    tx = raw.select("*", F.explode(F.array(F.from_json(col, ENRICHED_TX))).alias("_tx"))
    t = F.col("_tx")
    signature = F.coalesce(*[_text(t[k]) for k in ("signature", "transactionSignature", "txHash", "hash")])
    native = F.get(F.filter(t["nativeTransfers"], lambda x: _text(x["fromUserAccount"]).isNotNull()
                            & _text(x["toUserAccount"]).isNotNull()), F.lit(0))
    src = lambda x: F.coalesce(_text(x["fromUserAccount"]), _text(x["fromTokenAccount"]))
    dst = lambda x: F.coalesce(_text(x["toUserAccount"]), _text(x["toTokenAccount"]))
    token = F.get(F.filter(t["tokenTransfers"], lambda x: src(x).isNotNull() & dst(x).isNotNull()), F.lit(0))
    raw_amount = F.coalesce(token["tokenAmount"], token["amount"])
    nested = F.try_divide(
        F.get_json_object(raw_amount, "$.amount").try_cast("double"),
        F.pow(F.lit(10.0), F.coalesce(F.nullif(F.get_json_object(raw_amount, "$.decimals").try_cast("int"), F.lit(0)),
                                      F.lit(6))),
    )
    token_amount = F.when(raw_amount.startswith("{"), nested).otherwise(raw_amount.try_cast("double"))
    program = F.get(F.filter(t["instructions"], lambda i: _text(i["programId"]).isNotNull()), F.lit(0))["programId"]
    is_native = native.isNotNull()
    return (
        tx.select(
            signature.alias("signature"), *[c for c in raw.columns if c == "wallet"],
            F.when(is_native, F.trim(native["fromUserAccount"])).otherwise(src(token)).alias("sender"),
            F.when(is_native, F.trim(native["toUserAccount"])).otherwise(dst(token)).alias("receiver"),
            F.coalesce(F.when(is_native, native["amount"].try_cast("double") / float(LAMPORTS_PER_SOL))
                       .otherwise(token_amount), F.lit(0.0)).alias("amount"),
            F.when(is_native, "SOL").otherwise(F.coalesce(_text(token["mint"]), _text(token["tokenMint"]),
                                                         F.lit("unknown"))).alias("token"),
            F.coalesce(F.nullif(t["timestamp"], F.lit(0)), t["blockTime"], F.lit(0)).alias("ts"),
            F.coalesce(program, F.when(is_native, SYSTEM_PROGRAM).otherwise(TOKEN_PROGRAM)).alias("program_id"),
        )
        .filter("signature IS NOT NULL AND sender IS NOT NULL AND receiver IS NOT NULL")
    )


def transfers_from_instructions(tx_raw: DataFrame) -> DataFrame:
    """Every transfer instruction with two different ends."""
    i = F.col("i")
    return (
        tx_raw.select("signature", "block_time", "slot", F.explode("instructions").alias("i"))
        .filter((i["type"] == "transfer") & clean_wallet(i["source"]).isNotNull()
                & clean_wallet(i["destination"]).isNotNull() & (i["source"] != i["destination"]))
        .select("signature", i["source"].alias("sender"), i["destination"].alias("receiver"),
                F.coalesce(i["lamports"], F.lit(0)).alias("lamports"), F.col("block_time").alias("ts"), "slot")
    )


def edges_from_instructions(tx_raw: DataFrame) -> DataFrame:
    """Distinct (sender, receiver); a transaction without transfers counts as key[0] -> key[1]."""
    moves = F.filter("instructions", lambda i: (i["type"] == "transfer") & (i["source"] != i["destination"]))
    pairs = F.transform(moves, lambda i: F.struct(i["source"].alias("sender"), i["destination"].alias("receiver")))
    a, b = F.get("account_keys", F.lit(0)), F.get("account_keys", F.lit(1))
    fallback = F.when(a.isNotNull() & b.isNotNull() & (a != b),
                      F.array(F.struct(a.alias("sender"), b.alias("receiver"))))
    return tx_raw.select(
        F.explode(F.when(F.size(moves) > 0, pairs).otherwise(fallback)).alias("e")).select("e.*").distinct()


def transfers_from_balance_delta(tx_raw: DataFrame) -> DataFrame:
    """Sender is the fee payer; receiver is the account that gained most (first on ties)."""
    delta = F.zip_with("post_balances", "pre_balances", lambda post, pre: post - pre)
    best = F.array_max(delta)
    return tx_raw.withColumn("_d", delta).withColumn("_best", best).select(
        "signature",
        F.when(F.col("required_signatures") >= 1, F.get("account_keys", F.lit(0))).alias("sender"),
        F.when(F.col("_best") > 0, F.get("account_keys", (F.array_position("_d", F.col("_best")) - 1).cast("int")))
        .otherwise(F.get("account_keys", F.lit(1))).alias("receiver"),
        F.greatest(F.coalesce("_best", F.lit(0)), F.lit(0)).alias("lamports"),
        F.col("block_time").alias("ts"), "slot",
    )


def balance_change(tx_raw: DataFrame, wallets: DataFrame) -> DataFrame:
    """Per (transaction, wallet): post - pre, less the fee once more for the fee payer.

    Accounts of many transactions, like a program's, stay in place; the others meet the wallets in parts of
    ``TASK_ROWS`` rows.
    """
    zipped = F.arrays_zip("account_keys", "pre_balances", "post_balances")
    rows = tx_raw.select("signature", "block_time", "fee", F.posexplode(zipped).alias("pos", "z"))
    delta = F.col("z.post_balances") - F.col("z.pre_balances") - F.when(F.col("pos") == 0, F.col("fee")).otherwise(0)
    out = rows.select("signature", F.col("z.account_keys").alias("wallet"), delta.alias("delta_lamports"),
                      F.col("block_time").alias("ts"))
    held = tx_raw.select(F.explode("account_keys").alias("wallet")).groupBy("wallet").agg(F.count(F.lit(1)).alias("_n"))
    known = cut_lineage(held.join(wallets.select("wallet").distinct(), "wallet", "left_semi"))
    return join_skewed(out, known, "wallet", "_n", task_rows=TASK_ROWS).drop("_n")


def own_balance_change(wallet: str = "wallet") -> Column:
    """Balance change of the row's own wallet, without exploding the accounts."""
    pos = (F.array_position("account_keys", F.col(wallet)) - 1).cast("int")
    delta = F.get("post_balances", pos) - F.get("pre_balances", pos)
    return F.when(pos >= 0, delta - F.when(pos == 0, F.col("fee")).otherwise(0))


def programs_of() -> Column:
    outer = F.transform("instructions", lambda i: i["program_id"])
    inner = F.transform("inner_instructions", lambda i: i["program_id"])
    return F.array_compact(F.array_union(outer, F.coalesce(inner, F.array().cast("array<string>"))))


def tx_programs(tx_raw: DataFrame) -> DataFrame:
    return tx_raw.withColumn("programs", programs_of()).select("signature", "programs")


def flatten_tokens(assets: DataFrame, col: str = "raw") -> DataFrame:
    """Token records from asset JSON."""
    a = F.col("_a")
    meta, info = a["content"]["metadata"], a["token_info"]
    kind = lambda x: F.lower(F.trim(F.coalesce(_text(x["type"]), x["authority_type"], F.lit(""))))
    addr = lambda x: F.coalesce(_text(x["address"]), _text(x["authority"]))

    def authority(names: tuple[str, ...], snake: str, camel: str) -> Column:
        listed = F.filter(a["authorities"], lambda x: kind(x).isin(*names) & addr(x).isNotNull())
        last = addr(F.element_at(F.when(F.size(listed) > 0, listed), -1))
        return F.coalesce(last, _text(info[snake]), _text(info[camel]), _text(a[snake]), _text(a[camel]))

    typed = ("mint", "mint_authority", "freeze", "freeze_authority")
    empty = F.array().cast("array<string>")
    others = F.coalesce(F.transform(
        F.filter(a["authorities"], lambda x: ~kind(x).isin(*typed) & addr(x).isNotNull()), addr), empty)
    listed = F.coalesce(F.transform(meta["creators"], lambda c: F.coalesce(_text(c["address"]), _text(c["creator"]))),
                        empty)
    extra = F.filter(F.array_distinct(F.array_compact(listed)), lambda w: ~F.array_contains(others, w))
    mint_auth = authority(typed[:2], "mint_authority", "mintAuthority")
    freeze_auth = authority(typed[2:], "freeze_authority", "freezeAuthority")
    return assets.withColumn("_a", F.from_json(col, ASSET)).select(
        a["id"].alias("mint"), _text(meta["name"]).alias("name"), _text(meta["symbol"]).alias("symbol"),
        mint_auth.alias("mint_authority"), freeze_auth.alias("freeze_authority"),
        F.coalesce(F.nullif(info["supply"], F.lit(0)), a["supply"]).alias("supply"),
        F.coalesce(F.nullif(info["decimals"], F.lit(0)), a["decimals"]).alias("decimals"),
        F.concat(others, extra).alias("creator_wallets"),
        mint_auth.isNotNull().alias("mint_authority_exists"), freeze_auth.isNotNull().alias("freeze_authority_exists"),
        meta.isNull().alias("metadata_missing"),
    )
