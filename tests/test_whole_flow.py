"""Flow features over all transfers of a wallet against a literal walk."""

import random

import pytest

from ledgerwise.operators.features import flow_features

SCHEMA = ("signature string, wallet string, sender string, receiver string, amount_lamports bigint, ts bigint, slot bigint, "
          "program_id string, token string, err string")
COLS = ("total_tx", "unique_destinations", "rapid_tx_count", "avg_tx_interval", "percent_to_new_wallets",
        "tx_chain_length_estimate")


def walk(rows, n=None):
    per = {}
    for sig, a, b, ts, slot in rows:
        for w, other in {(a, b), (b, a)}:
            if w is not None:
                per.setdefault(w, []).append((sig, other, ts, slot))
    out = {}
    for w, mine in per.items():
        mine = sorted(mine, key=lambda r: (r[2] or 0, r[0]), reverse=True)[:n]
        ts = [t for _, _, t, _ in mine if t is not None]
        timed = [o for _, o, t, _ in mine if t is not None and o is not None]
        run = best = 0
        last = None
        for s in sorted(s for *_, s in mine if s is not None):
            run = run + 1 if last is not None and s - last <= 2 else 1
            best, last = max(best, run), s
        out[w] = (len(mine), len({o for _, o, _, _ in mine if o is not None}),
                  sum(sum(abs(t - x) <= 30 for x in ts) > 1 for t in ts),
                  (max(ts) - min(ts)) / (len(ts) - 1) if len(ts) > 1 else 0.0,
                  100.0 * len(set(timed)) / len(timed) if timed else 0.0, best)
    return out


@pytest.mark.parametrize("n", [None, 50])
def test_flow_equals_walk(spark, n):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        a, b = ("hot", f"p{rng.randint(0, 80)}") if i % 2 else (f"p{rng.randint(0, 9)}", rng.choice(["q", None, "p1"]))
        ts = rng.choice([None, 3_590 + rng.randint(0, 40), rng.randint(0, 90_000)])
        slot = rng.choice([None, 9_990 + rng.randint(0, 25), rng.randint(0, 40_000), 20_000 + rng.randint(-6, 6)])
        rows.append((f"s{i:04d}", a, b, ts, slot))
    df = spark.createDataFrame([(s, a, a, b, 1, t, k, "p", "SOL", None) for s, a, b, t, k in rows], SCHEMA)
    got = {r["wallet"]: tuple(r[c] for c in COLS) for r in flow_features(df, n).collect()}
    want = walk(rows, n)
    assert set(got) == set(want)
    for w in want:
        assert got[w] == pytest.approx(want[w], abs=0.0051), w


def test_all_transfers_by_default(spark):
    rows = [(f"s{i:03d}", "hot", "hot", f"p{i}", 1, 10 * i, i, "p", "SOL", None) for i in range(70)]
    hot = flow_features(spark.createDataFrame(rows, SCHEMA)).filter("wallet = 'hot'").collect()[0]
    assert tuple(hot[c] for c in COLS) == (70, 70, 70, 10.0, 100.0, 70)
