"""Training rows are computed once for all passes and never crowd one task."""

from pyspark.sql import functions as F

from ledgerwise.operators import ml


def test_features_are_computed_once(spark, monkeypatch):
    monkeypatch.setattr(ml, "TASK_ROWS", 100)
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x % 2

    rows = spark.range(300).select(F.concat(F.lit("w"), "id").alias("wallet"), F.udf(mark, "long")("id").alias("label"),
                                   (F.col("id") % 2 + F.col("id") % 3).alias("x"))
    t = ml.train_forest(rows, ["x"], trees=3, depth=3)
    assert {r.feature for r in t.importances.collect()} == {"x"} and seen.value == 300


def test_rows_are_spread_where_a_task_has_too_many(spark, monkeypatch):
    one = spark.range(0, 1000, 1, 1).select(F.col("id").alias("wallet"))
    same, kept = ml.in_parts(one, "wallet")
    assert same.rdd.getNumPartitions() == 1 and not kept and not same.is_cached
    monkeypatch.setattr(ml, "TASK_ROWS", 100)
    many, kept = ml.in_parts(one, "wallet")
    sizes = [r["count"] for r in many.groupBy(F.spark_partition_id()).count().collect()]
    assert many.rdd.getNumPartitions() == 10 and sum(sizes) == 1000 and max(sizes) < 200 and kept
    many.unpersist()
