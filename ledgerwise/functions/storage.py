"""Cutting lineage in iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    app = spark.sparkContext.applicationId
    return _local_dirs.setdefault(app, tempfile.mkdtemp(prefix="ledgerwise-"))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written in the block drops its shuffle files, as later steps read the written files."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write_step(df: DataFrame, path: str) -> None:
    """Write the rows and let Spark drop the shuffle files of this plan."""
    with dropping_shuffles(df.sparkSession):
        df.write.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and continue from the files.

    The files survive the loss of executors and, unlike an RDD checkpoint, the
    plan is computed a single time and read back columnar.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    write_step(df, path)
    return spark.read.schema(df.schema).parquet(path)


def cut_with_metrics(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut_lineage`` that also returns aggregates of the written rows, read back from the files.

    (Observed metrics would save this small job, but they leave a manager in the session
    that makes later MLlib evaluations fail to serialize.)
    """
    out = cut_lineage(df)
    return out, out.agg(*[c.alias(name) for name, c in metrics.items()]).first().asDict()


def release_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Delete the files of a step that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/step-" in name:
            release_path(df.sparkSession, name)


#: Rows of one wallet above which it is hot, and of one bucket on average.
HOT_ROWS = 500_000


@contextmanager
def by_wallet(rows: DataFrame) -> Iterator[list[tuple[DataFrame, bool]]]:
    """[(rows of ordinary wallets, False), (rows of hot wallets, True)] for the time of the block; the second only if there are any.

    Ordinary wallets are shuffled once and bucketed, so any number of windows and groups within a wallet need no other
    shuffle, and none of them fills a task.  Rows of hot wallets stay where they are; operators spread these.
    """
    spark = rows.sparkSession
    n = F.col("n")
    sizes = rows.groupBy("wallet").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.collect_list(F.when(n > HOT_ROWS, F.col("wallet"))).alias("hot")).first()
    is_hot = F.coalesce(F.col("wallet").isin(sizes.hot), F.lit(False))
    buckets = max(spark.sparkContext.defaultParallelism, -(-sizes.total // HOT_ROWS))
    name, path = f"wallets_{uuid.uuid4().hex}", f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        (rows.filter(~is_hot) if sizes.hot else rows).repartition(buckets, "wallet").write.bucketBy(buckets, "wallet").option(
            "path", path).saveAsTable(name)
    try:
        yield [(spark.table(name), False)] + ([(rows.filter(is_hot), True)] if sizes.hot else [])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        release_path(spark, path)
