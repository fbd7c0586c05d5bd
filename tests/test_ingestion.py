"""Ingestion runs its plan once and shuffles whole tables in parts of bounded size."""

from collections import Counter

from pyspark.sql import functions as F

from catalog import views as V
from ledgerwise.functions.storage import CLEANUP, cut_lineage
from ledgerwise.sources.transactions import balance_change, transfers_from_enriched


def test_a_shuffled_plan_is_written_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    df = spark.range(500).select(F.udf(mark, "long")("id").alias("x")).repartition(3, "x")
    out = V.Views(spark, str(tmp_path)).ingested("once", df)
    assert sorted(r.x for r in out.collect()) == list(range(500)) and seen.value == 500


def test_a_step_leaves_no_shuffle_files(spark):
    known = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    before, rows = known.size(), spark.range(500).groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(cut_lineage(rows).collect()) == sorted(rows.collect())
    kept = known.size() - before  # collect() keeps its own
    cut_lineage(rows)
    assert known.size() - before == kept == 1 and spark.conf.get(CLEANUP) == "false"


def test_enriched_text_is_parsed_once(spark):
    raw = spark.createDataFrame([('{"signature": "s", "tokenTransfers": [{"fromUserAccount": "a", "toUserAccount": "b", "amount": 2}]}',),
                                 (None,), ("{",)], "raw string")
    out = transfers_from_enriched(raw)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [(r.signature, r.sender, r.receiver, r.amount) for r in out.collect()] == [("s", "a", "b", 2.0)]


def test_transactions_do_not_depend_on_the_parts(spark, small, monkeypatch):
    rows = lambda: sorted(map(repr, V.Views(spark, small).tx_raw.collect()))
    monkeypatch.setattr(V, "_ingested", {})
    few = rows()
    size = V.Views(spark, small).parts("lineitem")
    monkeypatch.setattr(V, "_ingested", {})
    monkeypatch.setattr(V, "PART_BYTES", 4096)
    assert V.Views(spark, small).parts("lineitem") > size
    assert rows() == few and len(few) == V.Views(spark, small).table("lineitem").select("l_orderkey").distinct().count()


def test_an_account_of_all_transactions_is_not_one_tasks_work(spark):
    keys = F.array(F.concat(F.lit("w"), (F.col("id") % 50).cast("string")), F.lit("hot"), F.when(F.col("id") % 2 == 0, "other"))
    tx = cut_lineage(spark.range(4000).repartition(8).select(
        F.col("id").cast("string").alias("signature"), F.col("id").alias("block_time"), F.lit(5).cast("long").alias("fee"), keys.alias("account_keys"),
        F.array(F.lit(9).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")).alias("pre_balances"),
        F.array(F.lit(3).cast("long"), F.col("id"), F.lit(None).cast("long")).alias("post_balances")))
    wallets = spark.createDataFrame([("hot",), ("hot",), ("w3",), ("unseen",), (None,)], "wallet string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = balance_change(tx, wallets).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(str(i), "hot", i, i) for i in range(4000)] + [(str(i), "w3", -11, i) for i in range(3, 4000, 50)]
    assert sorted((r.signature, r.wallet, r.delta_lamports, r.ts) for r in rows) == sorted(want)
    assert max(Counter(r.part for r in rows).values()) < 2000


def test_token_accounts_are_counted_in_bounded_parts(spark, small, monkeypatch):
    rows = lambda: sorted(map(repr, V.Views(spark, small).counted_accounts().collect()))
    few = rows()
    monkeypatch.setattr(V, "PART_BYTES", 4096)
    n = V.Views(spark, small).parts("lineitem")
    plan = V.Views(spark, small).counted_accounts()._jdf.queryExecution().executedPlan().toString()
    assert n > 8 and "hashpartitioning(wallet#" in plan and f", {n}), REPARTITION_BY_NUM" in plan
    assert rows() == few


def test_token_accounts_are_counted_once(spark, small, monkeypatch):
    monkeypatch.setattr(V, "_ingested", {})
    v = V.Views(spark, small)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert "Aggregate" not in v.token_accounts._jdf.queryExecution().executedPlan().toString()
    assert rows(v.token_accounts) == rows(v.counted_accounts()) and v.token_accounts.dtypes == v.counted_accounts().dtypes
