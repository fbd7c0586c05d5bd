"""Records dealt out by wallet once: ordinary wallets need no further shuffle, hot ones keep their buckets, with the same features."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerwise.functions import storage
from ledgerwise.functions.storage import by_wallet
from ledgerwise.operators import drainer as D
from ledgerwise.operators import features as O

SCHEMA = ("signature string, sender string, receiver string, amount_lamports bigint, ts bigint, slot bigint, program_id string")


def transfers(spark):
    """Random transfers with nulls and repeated rows, some near the edges of buckets; wallet a takes part in most of them."""
    rng = random.Random(3)
    maybe = lambda x: None if rng.random() < 0.05 else x
    rows = [(maybe(f"s{i}"), maybe(rng.choice("aaabcd ")), maybe(rng.choice("abcdefgh")), maybe(i),
             maybe(rng.choice([0, 1_800, 3_600, 9_000]) + rng.randrange(-70, 70)), maybe(rng.choice([0, 10_000, 20_000]) + rng.randrange(-9, 9)),
             maybe(rng.choice("pqr"))) for i in range(400)]
    return spark.createDataFrame(rows + rows[:80], SCHEMA)


def features(spark):
    t = transfers(spark)
    records = O.wallet_records(t).withColumns({"approval_like": F.col("program_id") == "p", "has_swap": F.col("program_id") == "q"})
    wallets = t.select(F.col("sender").alias("wallet")).union(spark.createDataFrame([("new",)], "wallet string"))
    return [sorted(map(tuple, df.collect()), key=str) for df in (O.flow_features(t), D.drainer_features(records, wallets))]


def test_hot_and_ordinary_wallets_have_the_same_features(spark, monkeypatch):
    ordinary = features(spark)
    assert len(ordinary[0]) == 8 and any(r[1] for r in ordinary[1]) and any(r[2] for r in ordinary[1])
    for rows in (0, 100):  # all wallets are hot, one is
        monkeypatch.setattr(storage, "HOT_ROWS", rows or 1)
        assert features(spark) == ordinary


@pytest.mark.parametrize("limit, hot", [(500_000, set()), (100, {"a"})])
def test_rows_are_dealt_out_once(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(storage, "HOT_ROWS", limit)
    rows = spark.range(1_000).select(F.when(F.col("id") % 2 == 0, "a").when(F.col("id") > 9, F.concat(F.lit("w"), F.col("id") % 50)).alias("wallet"), "id")
    with by_wallet(rows) as split:
        found = [({r.wallet for r in df.select("wallet").distinct().collect()}, df.count()) for df, _ in split]
        assert [h for _, h in split] == [False] + [True] * bool(hot) and sum(n for _, n in found) == 1_000
        assert found[0][0] == {"a", None, *(f"w{i}" for i in range(1, 50, 2))} - hot and found[1:] == [(hot, 500)] * bool(hot)
        names = [t.name for t in spark.catalog.listTables() if t.name.startswith("wallets_")]
        assert len(names) == 1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("wallets_")]


def test_parts_of_ordinary_wallets_need_no_shuffle(spark):
    t = transfers(spark)
    records = O.wallet_records(t).withColumns({"approval_like": F.col("program_id") == "p", "has_swap": F.col("program_id") == "q"})
    with by_wallet(records.select(*D.RECORD)) as split:
        parts = O._flow_parts(*split[0]) + [part(split[0][0]) for part in (D._by_time, D._by_pair, D._by_slot)]
        for part in parts:
            assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()
