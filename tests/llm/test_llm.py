"""Operators for training data against plain code on small fixtures, with the edge cases their docstrings state."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "a b c d e f " * 400), (6, "é" * 300), (7, "x\x0b y\x85z ½ ²"),
         (8, "mail a.b@c.de or +1 (212) 555-0100, 10.0.0.256 10.0.0.25 4111 1111 1111 1111"), (9, "one two"), (9, "one two"),
         (10, "日本語 text \U0001f600 <|endoftext|> don't   stop")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, 0, 0) for i, t in EDGES],
                                 "doc_id bigint, text string, lang string, n_words int, ids int")


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return [w for w in re.split(SPACE, t or "") if w]


def test_near_duplicates_match_all_pairs(spark, docs, table):
    from ledgerwise.llm.near_dedup import near_duplicates

    base = " ".join(f"w{i}" for i in range(60))
    copies = [(1000 + k, base.replace(f"w{k} ", f"v{k} ")) for k in range(20)] + [(2000 + k, base) for k in range(30)]
    rng = np.random.default_rng(3)  # a group whose members are similar to each other from 0.4 to 0.9
    for k in range(120):
        w = [f"g{i}" for i in range(100)]
        for i in rng.choice(100, rng.integers(1, 9), replace=False):
            w[i] = f"x{rng.integers(0, 30)}"
        copies.append((3000 + k, " ".join(w)))
    extra = spark.createDataFrame(copies, "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").union(table.selectExpr("doc_id + 5000", "text").limit(150)).union(extra)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(rows).collect()}

    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in rows.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert near_duplicates(rows.limit(0)).collect() == []


def test_odd_sketch_estimates_similarity():
    from ledgerwise.llm.near_dedup import min_hashes, odd_sketch, similar_enough

    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    near, far = items.copy(), items.copy()
    near[:100], far[:700] = rng.integers(0, 2**63, 100, dtype=np.uint64), rng.integers(0, 2**63, 700, dtype=np.uint64)
    a, b, c = (odd_sketch(min_hashes(np.unique(x))) for x in (items, near, far))
    assert list(similar_enough([a, a], [b, c])) == [True, False]


def test_best_fit_decreasing_matches_a_plain_search():
    from ledgerwise.llm.packing import best_fit

    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 65, 500).tolist()
    groups, free = [], []
    for k in sorted(range(500), key=lambda i: (-lengths[i], i)):
        fits = [(free[g], g) for g in range(len(free)) if free[g] >= lengths[k]]
        g = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(64)
            groups.append([])
        free[g] -= lengths[k]
        groups[g].append(k)
    got = best_fit(lengths, 64)
    assert sorted(k for g in got for k in g) == list(range(500)) and len(got) == len(groups)
    assert all(sum(lengths[k] for k in g) <= 64 for g in got) and best_fit([], 64) == []


def test_packing_round_trip(docs):
    import tiktoken

    from ledgerwise.llm.bpe import read_ranks
    from ledgerwise.llm.packing import pack

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    back = Counter()
    parts = {}
    for r in pack(docs, path, P.PATTERN, 50256, length=64).collect():
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == len(pos) == 64 and r.cu_seqlens[0] == 0
        for d, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault((d, k), []).append(ids[a:b].tolist())
            back[d] += b - a
    for i, t in EDGES:
        want = [*enc.encode_ordinary(t or ""), 50256]
        got = [x for k in range(-(-len(want) // 64)) for x in parts[i, k][0]]
        assert got == want
    assert back[9] == 2 * (len(enc.encode_ordinary("one two")) + 1)
    assert pack(docs.limit(0), path, P.PATTERN, 50256).collect() == []


def test_pii_base_spans_match_plain_patterns(docs, table):
    from ledgerwise.llm.pii import KINDS, base_spans, find_pii, luhn

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for k, n in enumerate(KINDS):
            for m in re.finditer(plain[n], t):
                d = re.sub("[^0-9]", "", m[0])
                if (n == "email" or n == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                        or n == "card" and 14 <= len(d) <= 19 and luhn(d) or n == "phone" and 10 <= len(d) <= 15):
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    tricky = ["a@b.c_d@e.fg x@y.z@w.v", "1.2.3.4.5.6.7.8 0001.2.3.04 1.2.3.4567", "+1-234-567-8901+1-234-567-89011", "9" * 5000, "a" * 5000 + "@b",
              "4111-1111-1111-1111 4111  1111 1111 1111", "+1 (212) 555.0100 -", "@@ + . 1.1.1"]
    for t in tricky + [t or "" for _, t in EDGES]:
        assert base_spans(t) == brute(t), t
    for r, t in zip(find_pii(docs).collect(), [t for _, t in EDGES]):
        want = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(t or ""))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans.startswith(want[:5])
    assert find_pii(docs.limit(0)).collect() == []


def test_pii_bootstrap_finds_unseen_identifiers(spark):
    from ledgerwise.llm.pii import find_pii, redact

    known = [(i, f"please call me on +1 (212) 555-{i:04d} thanks") for i in range(40)]
    rows = spark.createDataFrame(known + [(99, "please call me on 212.555.9876 thanks"), (98, "in room 2125559876 today")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in find_pii(rows).collect()}
    assert got[99].spans == "phone:18:30" and got[99].n_phone == 0 and got[98].n_found == 0
    assert {r.text for r in redact(rows).filter("doc_id = 99").collect()} == {"please call me on <phone> thanks"}


def test_language_backoff_and_held_out_accuracy(spark, docs, table):
    from pyspark.sql import functions as F

    from ledgerwise.llm.language_id import Scorer, fit, predict

    held = F.col("doc_id") % 4 == 2
    model = fit(table.filter(~held).select("doc_id", "text", "lang"))
    got = predict(table.filter(held), model).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    edge = {r.doc_id: r for r in predict(docs, model).collect()}
    assert edge[1].lang_pred == edge[2].lang_pred == edge[3].lang_pred == "und" and edge[6].lang_pred != "und"
    assert Scorer(model).predict("qqqzzzqqq")[0] in model["langs"]
    assert {r.lang_pred for r in predict(docs, fit(table.limit(0).select("doc_id", "text", "lang"))).collect()} == {"und"}


def test_block_max_search_matches_full_scoring():
    from ledgerwise.llm.decontaminate import BLOCK, THRESHOLD, ItemIndex, tokens

    rng = np.random.default_rng(3)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(3, 40)))) for i in range(70)]
    index = ItemIndex(items)
    texts = ["", *(" ".join(rng.choice(vocab, rng.integers(1, 300))) for _ in range(20)), items[5][1]]
    for text, hits in zip(texts, index.search(texts)):
        w, half, want = tokens(text), 64, {}
        cuts = [w[i:i + 128] for i in range(0, max(1, len(w) - half), half)]
        for part in cuts:
            score = Counter()
            for t in {index.terms[x] for x in part if x in index.terms}:
                for b, (ends, impacts) in index.postings[t].items():
                    assert all(e // BLOCK == b for e in ends)
                    for e, x in zip(ends, impacts):
                        score[e] += x
            for e, x in score.items():
                if x >= THRESHOLD:
                    want[index.owner[e]] = max(x, want.get(index.owner[e], 0))
        assert {i for i, _ in hits} == set(want) and all(math.isclose(x, want[i], abs_tol=1e-5) for i, x in hits)


def test_contaminated_documents(spark, docs, table):
    from ledgerwise.llm.decontaminate import contaminated

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leak = items.first()
    planted = spark.createDataFrame([(77, "Some text before. " + leak.text.upper() + " and after"), (78, "clean words only")], "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in contaminated(docs.select("doc_id", "text").union(planted), items).collect()}
    assert found == {(77, leak.item_id)}
    assert contaminated(docs, items.limit(0)).collect() == []


def test_quality_counts_and_bounds(spark, docs, table):
    from pyspark.sql import functions as F

    from ledgerwise.llm.quality import binomial_tail, judge, keep_good

    labels = spark.createDataFrame([(1, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = docs.select("doc_id", "text", "lang", "n_words").union(table.selectExpr("doc_id + 100", "text", "lang", "1"))
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in judge(rows, labels).collect():
        t = texts[r.doc_id]
        w = words(t)
        seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and r.kept == (not r.base_failed)
    assert keep_good(docs, labels).columns == docs.columns and judge(docs.limit(0), labels).collect() == []
    cases = [(10, 0), (1000, 3), (5000, 30), (20000, 100), (1, 0), (0, 0)]
    got = spark.createDataFrame(cases, "n int, k int").select(binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for (n, k), r in zip(cases, got):
        want = sum(math.comb(n, i) * 0.01**i * 0.99**(n - i) for i in range(k + 1)) if k < n * 0.01 else 1.0
        assert math.isclose(r.p, want, rel_tol=1e-6)


def test_preference_pairs(spark):
    from ledgerwise.llm.preference import conversations, format_pairs, pairs_by_first_turn, pairs_with_foreign_reply

    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", None),
             (3, 0, "user", "bye"), (3, 0, "user", "bye")]
    convs = conversations(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    row = format_pairs(pairs_by_first_turn(convs)).collect()
    assert len(row) == 1 and (row[0].chosen_id, row[0].rejected_id, row[0].n_common) == (1, 2, 1)
    assert row[0].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    (span,) = row[0].rejected_mask
    assert row[0].rejected_completion[span.start:span.end] == "hello<|im_end|>\n"
    foreign = {r.chosen_id: r for r in format_pairs(pairs_with_foreign_reply(convs)).collect()}
    assert set(foreign) == {1, 2} and "hello" in foreign[1].rejected_completion and "yo" in foreign[2].rejected_completion
    assert format_pairs(pairs_by_first_turn(convs.limit(0))).collect() == []


def test_urls(spark):
    from ledgerwise.llm.queries import URL_RULES
    from ledgerwise.llm.url_filter import judge_urls

    cases = {None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no-scheme.com/": ("", "", None, "allow"),
             "http://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"),
             "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
             "http://example.com": ("example.com", "", None, "allow"), "http://example.com/en": ("example.com", "/en", "com/", "allow"),
             "x://net/es/1": ("net", "/es/1", "net/es/", "block"), "x://mynet/es/": ("mynet", "/es/", None, "allow"),
             "x://a.net/fr?/": ("a.net", "/fr", None, "allow"), "x://com.?q": ("com.", "", None, "allow")}
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    for r in judge_urls(rows, URL_RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r
    assert {r.verdict for r in judge_urls(rows, [], default="block").collect()} == {"block"}
    both = judge_urls(rows, [("block", "com", "/e"), ("allow", "com", "/e")]).filter("rule IS NOT NULL").collect()
    assert both and {(r.rule, r.verdict) for r in both} == {("com/e", "block")}


@pytest.mark.parametrize("min_share", [0, 0.01, 2])
def test_bpe_round_trip(spark, docs, min_share):
    """All pre-tokens folded, some, and none."""
    import tiktoken

    from ledgerwise.llm.bpe import Tokenizer, read_ranks

    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok = Tokenizer(spark, ranks, P.PATTERN, min_share=min_share)
    rows = tok.pack(tok.decode(tok.encode(docs))).collect()
    assert len(rows) == len(EDGES) and set(rows[0].asDict()) == {*docs.columns, "decoded", "packed"}
    for r in rows:
        want = enc.encode_ordinary(r.text or "")
        assert r.ids == want and bytes(r.decoded) == (r.text or "").encode() and bytes(r.packed) == np.array(want, "<u4").tobytes()
    assert tok.encode(docs.limit(0)).collect() == []


def test_token_counts(docs, table):
    from tokenizers import Tokenizer

    from ledgerwise.llm.token_counts import token_counts

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = docs.select("doc_id", "text").union(table.selectExpr("doc_id + 100", "text"))
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in token_counts(rows, path, P.PATTERN).collect():
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    assert token_counts(docs.limit(0), path, P.PATTERN).collect() == []
