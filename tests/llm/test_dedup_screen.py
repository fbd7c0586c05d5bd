"""The stated chance that the sketch loses a link at the limit, against the exact distribution."""

import re
from math import comb, exp

from ledgerwise.llm import near_dedup as N


def lost(bits, samples, screen, similarity=0.75):
    """Each differing sample flips two random bits; the pair is lost when too many bits are odd."""
    most = bits / 2 * (1 - exp((screen - 1) * 4 * samples / bits))
    odd, total = [1.0] + [0.0] * bits, 0.0
    for differing in range(samples + 1):
        chance = comb(samples, differing) * (1 - similarity) ** differing * similarity ** (samples - differing)
        total += chance * sum(p for k, p in enumerate(odd) if k > most)
        for _ in range(2):
            odd = [(odd[k - 1] * (bits - k + 1) / bits if k else 0.0) + (odd[k + 1] * (k + 1) / bits if k < bits else 0.0)
                   for k in range(bits + 1)]
    return total


def test_stated_figure_is_the_exact_one():
    stated = float(re.search(r"fails the sketch with\s+(?:less than\s+)?([0-9.]+e-[0-9]+)", N.__doc__)[1])
    exact = lost(N.SKETCH_BITS, N.BANDS * N.ROWS, N.SCREEN)
    assert 0.9 * exact <= stated <= 1.1 * exact, exact


def test_template_below_the_limit_costs_no_pairs(spark):
    """3 000 documents that share 71 % and are in one bucket: no links, and cells instead of pairs."""
    from pyspark.sql import functions as F

    from ledgerwise.llm.near_dedup import _across, near_duplicates

    n = 3_000
    stem = [f"t{i}" for i in range(82)]
    rows = [(i, " ".join(stem + [f"d{i}x{k}" for k in range(16)])) for i in range(n)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    reps = texts.select("doc_id", F.lit(94).cast("bigint").alias("n_shingles"), F.array(F.lit(5).cast("bigint")).alias("bands"))
    rest = texts.select(F.lit(5).cast("bigint").alias("key"), "doc_id", F.col("doc_id").alias("comp"))
    assert _across(rest, reps, texts).count() == 0
    near = [(n + k, " ".join(stem + [f"e{k}x{j}" for j in range(16)])) for k in range(2)] + [(n + 9, rows[0][1] + " more")]
    some = texts.filter("doc_id < 300").union(spark.createDataFrame(near, "doc_id bigint, text string"))
    got = {r.doc_id: r.component_id for r in near_duplicates(some).collect()}
    assert got[n + 9] == 0 and all(got[i] == i for i in [*range(300), n, n + 1])


def test_the_largest_component_is_not_compared_from_its_side(spark):
    """Each pair across components is met once, from the member of the smaller component, whatever the ids."""
    from pyspark.sql import functions as F

    from ledgerwise.llm.near_dedup import _across

    stem = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(stem + [f"d{i}x{k}" for k in range(4)])) for i in range(40)]
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    keys = F.array(F.lit(5).cast("bigint"), F.lit(6).cast("bigint"))
    reps = texts.select("doc_id", F.lit(100).cast("bigint").alias("n_shingles"), keys.alias("bands"))
    comp = F.when(F.col("doc_id") < 30, 0).when(F.col("doc_id") < 35, 30).otherwise(F.col("doc_id")).cast("bigint")
    rest = reps.select(F.explode("bands").alias("key"), "doc_id", comp.alias("comp"))
    of = lambda i: 0 if i < 30 else 30 if i < 35 else i
    got = [(r.a, r.b) for r in _across(rest, reps, texts).collect()]
    assert sorted(map(sorted, got)) == [[i, j] for i in range(40) for j in range(i + 1, 40) if of(i) != of(j)]
    assert all(a >= 30 for a, _ in got)
