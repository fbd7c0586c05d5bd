"""Elias-Fano sequences against sorted arrays; language-model scores against a plain trigram model."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (1, 2**63), (1000, 50), (1000, 2**60), (20_000, 2**55), (5000, 5000), (1000, 2**64 - 1)])
def test_elias_fano(n, top):
    from ledgerwise.llm.ngram_trie import EliasFano

    rng = np.random.default_rng(n + top % 97)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e = EliasFano.build(v)
    assert (e.access(np.arange(n)) == v).all()
    one = np.uint64(1)
    q = np.concatenate([v, v + one, v - one, rng.integers(0, top, 300, dtype=np.uint64, endpoint=True), np.array([0], np.uint64)])
    at, same = e.successor(q)
    assert (at == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all()
    if n == 20_000:
        assert 8 * (e.low.nbytes + e.high.nbytes) < n * (math.log2(top / n) + 3)


def test_trie_round_trip_and_relative_ranks():
    from ledgerwise.llm.ngram_trie import NgramTrie

    rng = np.random.default_rng(1)
    tri = sorted({tuple(x) for x in rng.integers(0, 12, (600, 3)).tolist()}, key=lambda t: (t[1], t[0], t[2]))  # v, m, w
    roots = sorted({m for _, m, _ in tri})
    words = sorted({(roots.index(m), w) for _, m, w in tri})
    ctx = sorted({(roots.index(m), v) for v, m, _ in tri})
    rows = sorted((ctx.index((roots.index(m), v)), words.index((roots.index(m), w))) for v, m, w in tri)
    p = lambda n: rng.choice([0.25, 0.5, 0.75], n)
    cols = lambda x: np.array(x).T
    pw, pc, pt = p(len(words)), p(len(ctx)), p(len(rows))
    trie = NgramTrie.build(np.array(roots, np.uint64), *cols(words), pw, *cols(ctx), pc, *cols(rows), pt).mapped()
    every = [(v, m, w) for v in range(13) for m in range(13) for w in range(13)]
    v, m, w = cols(every).astype(np.uint64)
    root = trie.root(m)
    word, context = trie.word(root, w), trie.context(root, v)
    found = trie.trigram(root, context, word)
    book = trie.codes["ranks_book"]
    for t, k, c in zip(every, found, trie.code("ranks", found)):
        assert (k >= 0) == (t in set(tri)) or (k >= 0) == (t in tri)
        if k >= 0:
            assert book[c] == pt[k]
    again = NgramTrie.open(np.frombuffer(trie.to_bytes(), np.uint8))
    assert (again.trigram(again.root(m), again.context(again.root(m), v), again.word(again.root(m), w)) == found).all()


def plain(rows, discount=0.75):
    def split(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]

    one, two, three, lines = Counter(), Counter(), Counter(), []
    for i, t in rows:
        out = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        s = ["<s>", "<s>", *split(t), "</s>"]
        lines.append((i, out, s))
        if not out and i is not None:
            for k in range(2, len(s)):
                one[s[k]] += 1
                two[s[k - 1], s[k]] += 1
                three[tuple(s[k - 2:k + 1])] += 1
    n, v = sum(one.values()), len(one)
    t2, n2, t3, n3 = Counter(), Counter(), Counter(), Counter()
    for (a, _), c in two.items():
        t2[a] += c
        n2[a] += 1
    for (a, b, _), c in three.items():
        t3[a, b] += c
        n3[a, b] += 1
    for i, out, s in lines:
        base = score = known = 0
        for k in range(2, len(s)):
            u, m, w = s[k - 2:k + 1]
            p = (one[w] + 1) / (n + v + 1)
            base += math.log10(p)
            known += one[w] > 0
            if t2[m]:
                p = max(two[m, w] - discount, 0) / t2[m] + discount * n2[m] / t2[m] * p
            if t3[u, m]:
                p = max(three[u, m, w] - discount, 0) / t3[u, m] + discount * n3[u, m] / t3[u, m] * p
            score += math.log10(p)
        yield i, out, len(s) - 2, known, n, base, score


def order(r):
    return r[0] is None, r[0] or 0, r[2], r[5]


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


@pytest.mark.parametrize("shard_bytes, part_words", [(8_000_000, 10**6), (30_000, 5_000), (3_000, 700)])
def test_scores_match_a_plain_model(spark, shard_bytes, part_words):
    """One trie and one part; several of both; tries so small that frequent words are split over many."""
    from ledgerwise.llm.lm_scoring import score_texts

    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    edges = [(None, "a b c"), (90001, None), (90002, ""), (90003, " \n"), (90004, "Word word"), (90004, "Word word"), (90005, "x\x0by\x85z é")]
    df = table.union(spark.createDataFrame(edges, "doc_id long, text string")).selectExpr("*", "'x' AS score").repartition(5)
    want = sorted(plain([(r.doc_id, r.text) for r in df.collect()]), key=order)
    got = sorted(map(tuple, score_texts(df, held_out(), shard_bytes=shard_bytes, part_words=part_words).collect()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
        assert math.isclose(a[6], b[6], rel_tol=1e-2 if shard_bytes > 10**6 else 1e-5)  # codes of one byte


def test_held_out_text_is_likelier_than_by_single_words(spark):
    from ledgerwise.llm.lm_scoring import score_texts

    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = score_texts(df, held_out()).filter("held_out AND n_tokens > 50").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_edges(spark):
    from ledgerwise.llm.lm_scoring import score_texts, tries
    from ledgerwise.llm.ngram_trie import NgramTrie

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert score_texts(df.limit(0), held_out()).collect() == []
    for r in score_texts(df, F.lit(True)).collect():  # nothing to learn from
        assert (r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 0, 0, 0.0, 0.0)
    long = "w" * 1_000_000 + " " + "q r s " * 100_000
    (r,) = score_texts(spark.createDataFrame([(1, long)], "doc_id long, text string"), F.lit(False)).collect()
    assert r.n_tokens == r.n_known == r.train_tokens == 300_002
    kept = tries(spark.read.parquet(f"{SF}/documents.parquet"), shard_bytes=100_000).collect()
    assert len(kept) > 1
    for t in kept:
        assert NgramTrie.open(np.frombuffer(t.trie, np.uint8)).ranks.n == t.trigrams > 0
