"""CSV and table sources, sinks, and keyed table maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.functions.common import DAY, LAMPORTS_PER_SOL, clean_wallet, newest_n

ADDRESS_PATTERN = "^[1-9A-HJ-NP-Za-km-z]{32,44}$"
DIALECTS = {
    "ledger": {},
    "explorer": {"from_wallet": "sender", "to_wallet": "receiver", "timestamp": "ts"},
}


def read_wallet_csv(spark: SparkSession, path: str, extra_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct wallets of a headered CSV: column ``wallet``, else ``address``, else the first one."""
    df = spark.read.csv(path, header=True)
    name = next((c for c in ("wallet", "address") if c in df.columns), df.columns[0])
    kept = df.select(clean_wallet(name).alias("wallet"), *[c for c in extra_cols if c in df.columns])
    return kept.filter("wallet IS NOT NULL").dropDuplicates(["wallet"])


def normalize_transfers(df: DataFrame, dialect: str = "ledger") -> DataFrame:
    """One column set for both dialects, amount in SOL, rows with a blank end dropped."""
    df = df.withColumnsRenamed(DIALECTS[dialect])
    sol = F.col("amount_lamports") / float(LAMPORTS_PER_SOL) if "amount_lamports" in df.columns else F.col("amount")
    return df.withColumns({
        "sender": clean_wallet("sender"), "receiver": clean_wallet("receiver"), "amount_sol": sol.cast("double"),
    }).filter("sender IS NOT NULL AND receiver IS NOT NULL")


def incremental_append(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(new rows, one-row table with their count); rows whose key is present are ignored."""
    fresh = incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return fresh, fresh.agg(F.count(F.lit(1)).alias("inserted_count"))


def upsert_by_key(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All incoming rows, plus the existing rows whose key is not among them."""
    kept = existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming)


def recent_history(transfers: DataFrame, n: int | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """All transfers of the period, or the newest ``n`` of each wallet."""
    df = transfers
    if since is not None:
        df = df.filter(F.col("ts") >= since)
    if until is not None:
        df = df.filter(F.col("ts") <= until)
    if n is None:
        return df
    return newest_n(df, ["wallet"], [F.coalesce("ts", F.lit(0)).desc(), F.col("signature").desc()], n,
                    salt_cols=["signature"])


def days_back_filter(transfers: DataFrame, as_of: int, days: int) -> DataFrame:
    return transfers.filter(F.col("ts") >= as_of - days * DAY) if days > 0 else transfers


def valid_address(c: Column) -> Column:
    return c.rlike(ADDRESS_PATTERN)


def import_wallets(csv_rows: DataFrame, tracked: DataFrame) -> DataFrame:
    """One row per wallet of an import: status imported, duplicate or invalid, and how often it occurs."""
    rows = csv_rows.select(clean_wallet("wallet").alias("wallet"), clean_wallet("label").alias("label"))
    per_wallet = rows.filter("wallet IS NOT NULL").groupBy("wallet").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNull()).alias("empty_labels"))
    known = tracked.select("wallet").distinct().withColumn("_known", F.lit(True))
    status = (F.when(~valid_address(F.col("wallet")), "invalid").when(F.col("_known"), "duplicate")
              .otherwise("imported"))
    return per_wallet.join(known, "wallet", "left").select("wallet", status.alias("status"), "n", "empty_labels")


def import_report(status: DataFrame) -> DataFrame:
    """Totals of ``import_wallets``: repeats of a valid wallet count as duplicates."""
    n = F.col("n")
    valid = F.col("status") != "invalid"
    return status.agg(
        F.count_if(F.col("status") == "imported").alias("imported"),
        F.coalesce(F.sum(F.when(valid, n - (F.col("status") == "imported").cast("int"))), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(~valid, n)), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum("empty_labels"), F.lit(0)).alias("empty_labels"),
    )


def parse_list_column(c: Column) -> Column:
    """Array from JSON or Python list text, else from text separated by ``;`` or ``,``."""
    text = F.trim(c)
    listed = F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")
    parts = F.when(text.startswith("["), listed).otherwise(F.split(text, "[;,]"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def distinct_owners(token_accounts: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct owners of each mint: all, or the first ``n`` by owner."""
    owners = token_accounts.select("mint", F.col("wallet").alias("owner")).filter("owner IS NOT NULL").distinct()
    return owners if n is None else newest_n(owners, ["mint"], [F.col("owner")], n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
