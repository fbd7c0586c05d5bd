"""The corpus pipeline against plain code, stage by stage, each on what the one before it kept."""

import re
from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def good(t):
    w = words(t)
    seen = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    times = Counter(seen)
    covered = {j for i, s in enumerate(seen) if times[s] > 1 for j in range(i, i + 5)}
    return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)


def kept_ids(rows):
    """Ids that are the smallest of their group of near-duplicates."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = {}
    for r in rows:
        w = words(low(r[1]))
        sets[r[0]] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def leaks(rows, items):
    from ledgerwise.llm.decontaminate import GRAM, OVERLAP, grams, question_and_answer, tokens

    wanted = [[grams(part) for part in question_and_answer(text)] for _, text in items if tokens(text)]
    found = set()
    for r in rows:
        w = tokens(r[1])
        have = {n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for n in range(1, GRAM + 1)}
        if any(all(not g or len(g & have[len(next(iter(g)))]) >= OVERLAP * len(g) for g in pair) for pair in wanted):
            found.add(r[0])
    return found


def redacted(t):
    from ledgerwise.llm.pii import KINDS, base_spans

    out, at = [], 0
    for a, k, b in base_spans(t):
        if a >= at:
            out += [t[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(out) + t[at:]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    table = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    leak = items.orderBy("item_id").first().text
    base = [f"word{i}" for i in range(60)]
    extra = [(5000 + k, " ".join(base[:k] + [f"new{k}"] + base[k + 1:])) for k in range(12)]  # near copies
    extra += [(6000, None), (6001, ""), (6002, "too short"), (6003, "again and again we go " * 20), (6004, " ".join(base) + f" {leak} " + "tail " * 3),
              (6005, "write to someone at a.b@example.org or call +1 (212) 555-0100 or look at host 10.0.0.7 when the list is out"),
              (6006, "clean text with twelve words that nobody has written before in here"), (6007, " ".join(f"u{i}" for i in range(8_000)))]
    extra += [extra[-2]] * 2  # repeated rows
    rows = spark.createDataFrame([(i, t, "en" if i % 2 else None, "made", len(t or "")) for i, t in extra], SCHEMA)
    table.filter("doc_id < 100").union(rows).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_match_plain_code(spark, corpus):
    import tiktoken

    from ledgerwise.llm.bpe import read_ranks

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = sorted(map(tuple, docs.collect()), key=str)
    plain = {
        "quality rules": lambda rows: [r for r in rows if good(r[1])],
        "near-dedup": lambda rows: [r for r in rows if r[0] in kept_ids(rows)],
        "decontamination": lambda rows: [r for r in rows if r[0] not in leaks(rows, items)],
        "personal data": lambda rows: [(r[0], redacted(r[1]), r[2], r[3], len(redacted(r[1]))) for r in rows],
    }
    sizes = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "near-dedup":
            keep = kept_ids(rows)
            want = [r for r in rows if r[0] in keep]
        else:
            want = plain[name](rows)
        out = stage(spark, docs, corpus)
        assert out.columns == COLUMNS
        rows = sorted(map(tuple, out.collect()), key=str)
        assert rows == sorted(want, key=str), name
        docs = spark.createDataFrame(rows, SCHEMA)
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    ids = [r[0] for r in rows]
    assert 5000 in ids and not set(range(5001, 5012)) & set(ids) and 6004 not in ids and ids.count(6006) == 3 and 6007 in ids
    assert "<email> or call <phone> or look at host <ip>" in next(r[1] for r in rows if r[0] == 6005)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(last) == len(rows)
    for r in last:
        assert r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.exact
    whole = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, corpus).collect())
    assert whole == sorted((r.doc_id, r.n_tokens) for r in last)


def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        assert out.collect() == [], name
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == COLUMNS
