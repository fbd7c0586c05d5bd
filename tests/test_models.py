"""Model checks from stored predictions, merged features, and own balances that fell."""

from pyspark.sql import functions as F

from ledgerwise.operators import analysis, ml


def test_class_metrics_are_those_of_the_predictions(spark):
    pairs = [(1.0, 1.0)] * 30 + [(1.0, 0.0)] * 10 + [(0.0, 1.0)] * 20 + [(0.0, 0.0)] * 40
    got = dict(ml.class_metrics(spark.createDataFrame(pairs, "label double, prediction double")))
    assert got == {"precision": 0.6, "recall": 0.75, "confusion_0_0": 40.0, "confusion_0_1": 20.0, "confusion_1_0": 10.0, "confusion_1_1": 30.0}
    one = dict(ml.class_metrics(spark.createDataFrame([(0.0, 0.0)], "label double, prediction double")))
    assert one["precision"] == one["recall"] == 0.0 and one["confusion_0_0"] == 1.0


def test_trust_model_merges_flow_and_drainer_features(spark):
    base = spark.range(400).select(F.concat(F.lit("w"), "id").alias("wallet"), (F.col("id") % 2).alias("label"),
                                   *[(F.col("id") * 0).alias(c) for c in analysis.FEATURE_NAMES])
    flow = spark.range(300).select(F.concat(F.lit("w"), "id").alias("wallet"), (F.col("id") % 2).cast("double").alias("total_tx"))
    drainer = spark.range(0, 400, 7).select(F.concat(F.lit("w"), "id").alias("wallet"), F.lit(1).alias("rapid_outflow_count"))
    t = ml.train_trust_model(base, flow, drainer)
    names = {r.feature: r.importance for r in t.importances.collect()}
    assert {"total_tx", "rapid_outflow_count"} <= set(names) and max(names, key=names.get) == "total_tx"
    m = {r.metric: r.value for r in t.metrics.collect()}
    cells = sum(v for k, v in m.items() if k.startswith("confusion"))
    assert 40 < cells < 130 and m["accuracy"] == (m["confusion_0_0"] + m["confusion_1_1"]) / cells
    assert m["precision"] == m["confusion_1_1"] / (m["confusion_1_1"] + m["confusion_0_1"]) > 0.6


def test_dropped_balances_match_all_pairs(spark):
    bal = "array<struct<account_index:int,owner:string,mint:string,ui_amount:double>>"
    rows = [("w", [(0, "w", "a", 5.0), (1, "w", "b", 1.0), (2, "x", "c", 9.0), (1, "w", "b", 4.0)],
             [(0, "w", "a", 4.0), (1, "w", "b", 2.0), (2, "x", "c", 0.0), (3, "w", "d", 0.0), (1, "w", "e", 3.0), (0, "w", "f", 5.0)]),
            ("w", None, [(0, "w", "g", 0.0)]), ("w", [(0, "w", "h", None)], [(0, "w", "h", 1.0)]), ("w", [(0, "w", "i", 1.0)], None)]
    df = spark.createDataFrame(rows, f"wallet string, token_balances_pre {bal}, token_balances_post {bal}")
    got = [sorted(r[0] or []) for r in df.select(analysis._dropped_mints()).collect()]
    want = [sorted(m for i, o, m, u in (post or []) if o == w and any(j == i and v is not None and v > u for j, _, _, v in (pre or [])))
            for w, pre, post in rows]
    assert got == want == [["a", "b", "e"], [], [], []]
