"""Quality rules: linear time on unspaced text, and cutoffs certified on enough labels, against plain code."""

import math
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")


def test_unspaced_text_costs_linear_time(spark):
    from ledgerwise.llm.quality import text_counts

    def seconds(n):
        docs = spark.createDataFrame([("x" * n,), ("a b c d e f " + "y" * n,)], "text string")
        start = time.perf_counter()
        rows = [r.n_repeat_words for r in text_counts(docs).collect()]
        return time.perf_counter() - start, rows

    seconds(1000)
    small, big = seconds(100_000), seconds(1_000_000)
    assert small[1] == big[1] == [0, 0] and big[0] < 20 * small[0] + 2


def tail(n, k, p):
    if k >= n * p:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
    return math.fsum(map(math.exp, logs))


def test_certified_cutoffs_match_plain_code(spark):
    """Two strata: one with enough good documents to certify cutoffs, one without."""
    from ledgerwise.llm.quality import ALPHA, CUTOFFS, DELTA, judge

    word = lambda i, k: f"w{i}x{k}"
    rows = []
    for i in range(2600):
        symbols = "#" * (i % 40) if i % 131 == 0 else ""
        rows.append((i, " ".join(word(i, k) for k in range(12)) + " " + symbols, "en" if i < 2500 else None))
    rows += [(5000 + i, " ".join(word(i, k) for k in range(12)) + " " + "#" * 60, lang) for i, lang in enumerate(["en", None])]
    labels = [(i, 1, 0) for i in range(2600)] + [(3, 0, 0), (5000, 0, 1), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = judge(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()

    share = lambda r: {"symbols": 1000 * r.n_symbols / r.word_chars, "lines": 1000 * r.n_dup_lines / r.n_lines,
                       "repeats": 1000 * r.n_repeat_words / r.n_words}
    lang = {i: x for i, _, x in rows}
    by = {s: [r for r in got if lang[r.doc_id] == s and r.doc_id < 2600 and not r.base_failed] for s in ("en", None)}
    cut = {}
    for s, good in by.items():
        for name, (_, cuts) in CUTOFFS.items():
            cut[s, name] = None
            for c in cuts:
                k = sum(share(r)[name] > c for r in good)
                if tail(len(good), k, ALPHA / len(CUTOFFS)) > DELTA / (len(by) * len(CUTOFFS)):
                    break
                cut[s, name] = c
    assert cut["en", "symbols"] is not None and all(cut[None, name] is None for name in CUTOFFS)
    for r in got:
        s = lang[r.doc_id]
        over = any(cut[s, name] is not None and share(r)[name] > cut[s, name] for name in CUTOFFS)
        assert r.kept == (not r.base_failed and not over)
        assert all(r[f"cutoff_{name}"] == cut[s, name] for name in CUTOFFS)
    verdict = {r.doc_id: r.kept for r in got}
    assert not verdict[5000] and verdict[5001]


def test_edges(spark):
    from ledgerwise.llm.quality import keep_good

    good = " ".join(f"v{i}" for i in range(20))
    rows = [(1, None, None, 1), (2, "", "en", 2), (3, good, None, 3), (3, good, None, 4), (None, good, "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words int")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    kept = keep_good(docs, none)
    assert kept.columns == docs.columns and sorted(r.n_words for r in kept.collect()) == [3, 4, 5]
    assert keep_good(docs.filter(F.lit(False)), none).collect() == []
