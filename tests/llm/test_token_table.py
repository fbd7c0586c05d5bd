"""Frequent pre-tokens by merged summaries, and long pre-tokens."""

from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")


def test_summaries_keep_frequent_pieces(spark, monkeypatch):
    import pandas as pd

    from ledgerwise.llm import token_counts as T

    monkeypatch.setattr(T, "SUMMARY", 50)
    counts = [Counter({f"p{i}": 1000 // (i + 1) + k for i in range(400)}) for k in range(9)]
    rows = pd.DataFrame({"met": [c.total() for c in counts], "summary": [T._packed(T.trimmed(c)) for c in counts]})
    met, seen = T._merged(rows)
    exact = sum(counts, Counter())
    assert met == exact.total() and len(seen) <= 50
    for w, n in exact.items():  # a summary never overcounts and loses at most met / SUMMARY a merge level
        assert seen[w] <= n and (n <= 2 * met / 50 or w in seen)


def test_table_of_all_texts(spark):
    from tokenizers import Tokenizer

    from ledgerwise.llm.token_counts import frequent_pretokens

    path = P.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("the cat the dog",), ("the end",), (None,), ("",)], "text string").repartition(3)
    tok = Tokenizer.from_file(path)
    got = {r.piece: r.n_tokens for r in frequent_pretokens(df, path, P.PATTERN, min_share=0.1).collect()}
    assert set(got) == {"the", " the", " cat", " dog", " end"}
    assert all(n == len(tok.encode(w, add_special_tokens=False).ids) for w, n in got.items())
    assert frequent_pretokens(df.limit(0), path, P.PATTERN).collect() == []


def test_long_pre_token_and_bounded_cache(spark):
    from tokenizers import Tokenizer

    from ledgerwise.llm import token_counts as T

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a" * 1_000_000, "b" * 300_000 + " x" * 100_000, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in T.token_counts(df, path, P.PATTERN).collect():
        assert r.n_tokens == len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
    counts = T.Counts(path, P.PATTERN, {})
    for k in range(30):
        counts.learn({"q" * 500_000 + str(k)})
    assert counts.chars <= T.CACHE_CHARS + 500_002
