"""Streaming operators expressed with built-in sources, windows and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerwise import params as P
from ledgerwise.functions.storage import release_path, shared_dir
from ledgerwise.operators.features import (
    anomaly_flags, base_trust_score, features_from_pairs, merge_pairs, wallet_pairs,
)
from ledgerwise.operators.reports import check_transfers, receiver_risk
from ledgerwise.schemas import TRANSFERS


def stream_transfers(spark: SparkSession, path: str, schema: str = TRANSFERS, fmt: str = "parquet",
                     max_files: int | None = None, **options: str) -> DataFrame:
    """Transfers arriving as files (or any streaming format), with ``event_time`` for watermarks."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_event_time(reader.load(path))


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds("ts"))


def stream_dedupe(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First row per (wallet, signature); the state is dropped once the watermark has passed it."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["wallet", "signature"])


def stream_debounce(stream: DataFrame, gap: str = "1 second", delay: str = "10 minutes") -> DataFrame:
    """Rows of a wallet closer than ``gap`` become one session."""
    session = F.session_window("event_time", gap)
    return stream.withWatermark("event_time", delay).groupBy("wallet", session.alias("s")).agg(F.count(F.lit(1)).alias("n")).select(
        "wallet", F.unix_seconds("s.start").alias("session_start"), F.unix_seconds("s.end").alias("session_end"), "n")


def stream_usage_hourly(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Hourly usage per key and endpoint, corrected by late rows until the watermark passes the hour."""
    ok = F.col("status") < 400
    hour = F.window("event_time", "1 hour")
    return stream.withWatermark("event_time", delay).groupBy("api_key", "endpoint", hour.alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("errors"),
        F.sum(F.col("response_ms").cast("decimal(28,6)")).cast("double").alias("_ms"),
    ).select("api_key", "endpoint", F.unix_seconds("w.start").alias("hour"), "requests", "success", "errors",
             (F.col("_ms") / F.col("requests")).alias("avg_ms"))


def stream_check_transfers(stream: DataFrame, scores: DataFrame, reasons: DataFrame, members: DataFrame,
                           scam: DataFrame) -> DataFrame:
    """Each proposed transfer joined with the static receiver table."""
    return check_transfers(stream, receiver_risk(scores, reasons, members, scam))


def stream_rolling(stream: DataFrame, delay: str = "1 day", length: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Sliding totals per wallet."""
    w = F.window("event_time", length, slide)
    return stream.withWatermark("event_time", delay).groupBy("wallet", w.alias("w")).agg(
        F.sum("amount_lamports").alias("volume"), F.count(F.lit(1)).alias("tx_count")).select(
        F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), "wallet", "volume", "tx_count")


HISTORY_BUCKETS = 64
#: So many runs of one level are merged into one of the next.
FAN_IN = 8


def live_runs(batches: int) -> list[tuple[int, int]]:
    """(level, first batch) of the runs that hold the first ``batches`` batches: the digits of that number.

    A run of level L covers FAN_IN ** L batches, so there are less than FAN_IN per level.
    """
    out, level, size = [], 0, 1
    while size <= batches:
        end = batches - batches % size
        out += [(level, end - (k + 1) * size) for k in range(batches // size % FAN_IN)]
        level, size = level + 1, size * FAN_IN
    return sorted(out, key=lambda r: r[1])


def finished_merges(batches: int) -> list[tuple[int, int]]:
    """Runs (level, first batch) that become complete with the last of ``batches`` batches, from the lowest level."""
    out, level, size = [], 1, FAN_IN
    while batches and batches % size == 0:
        out.append((level, batches - size))
        level, size = level + 1, size * FAN_IN
    return out


def parts_of(level: int, first: int) -> list[tuple[int, int]]:
    """The runs that a run is merged from."""
    return [(level - 1, first + k * FAN_IN ** (level - 1)) for k in range(FAN_IN)]


def stream_features(stream: DataFrame, history_path: str, sink_path: str, checkpoint: str,
                    cfg: P.AnomalyConfig = P.AnomalyConfig()) -> StreamingQuery:
    """Features, flags and score of the wallets touched by each micro-batch.

    The history keeps only aggregates per (wallet, counterparty) in runs, partitioned by a hash bucket of the wallet.
    A batch writes one run; ``FAN_IN`` runs of a level are merged into one of the next, so a batch reads a
    number of runs that grows with the logarithm of the batches, and of these the buckets of its own wallets (at most
    ``HISTORY_BUCKETS`` numbers reach the driver).  Which runs there are follows from the batch number
    alone.  A merged run's parts are deleted by the batch after the merge, when the merging one is committed, so a replayed batch
    finds what it read and writes the same files again.
    """
    spark = stream.sparkSession

    def path(run: tuple[int, int]) -> str:
        return f"{history_path}/run={run[0]}-{run[1]}"

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = wallet_pairs(batch).withColumn("bucket", F.pmod(F.xxhash64("wallet"), F.lit(HISTORY_BUCKETS)))
        kind = rows.schema

        def read(runs: list[tuple[int, int]]) -> DataFrame:
            return spark.read.schema(kind).option("basePath", history_path).parquet(*map(path, runs))

        def write(df: DataFrame, run: tuple[int, int]) -> None:
            df.write.mode("overwrite").partitionBy("bucket").parquet(path(run))

        for level, first in finished_merges(batch_id):
            for part in parts_of(level, first):
                release_path(spark, path(part))
        write(rows, (0, batch_id))
        own = read([(0, batch_id)])
        touched = own.select("wallet").distinct()
        buckets = [r[0] for r in own.select("bucket").distinct().collect()]
        known = read([*live_runs(batch_id), (0, batch_id)]).filter(F.col("bucket").isin(buckets)).join(touched, "wallet", "left_semi")
        features = features_from_pairs(merge_pairs(known))
        flags = anomaly_flags(features, cfg)
        scored = features.join(flags, "wallet").join(base_trust_score(flags), "wallet")
        scored.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")
        for level, first in finished_merges(batch_id + 1):
            merged = merge_pairs(read(parts_of(level, first))).withColumn("bucket", F.pmod(F.xxhash64("wallet"), F.lit(HISTORY_BUCKETS)))
            write(merged.select(kind.names).repartition("bucket", F.pmod(F.xxhash64("counterparty"), F.lit(4))), (level, first))

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_to_files(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now and return its output rows with their batch number.

    Each micro-batch overwrites its own folder in the shared directory; nothing passes
    through the driver.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    schema = stream.schema.add("batch_id", T.LongType())
    return spark.read.schema(schema).option("basePath", f"{root}/out").parquet(f"{root}/out")


def newest_version(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last written version of each key of an update-mode stream."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")
