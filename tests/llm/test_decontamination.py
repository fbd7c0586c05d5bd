"""Decontamination against a brute force over ``verify``: split items, repeated ids, many indexes and passes."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")


def brute(docs, items):
    from ledgerwise.llm.decontaminate import OVERLAP, ItemIndex

    out = {}
    for doc, text in docs:
        for item, body in items:
            if text and body and item is not None:
                index = ItemIndex([(item, body)])
                if index.blocks:
                    q, a = index.verify(text, 0)
                    if q >= OVERLAP and a >= OVERLAP:
                        old = out.get((doc, item), (0.0, 0.0))
                        out[doc, item] = max(old[0], q), max(old[1], a)
    return out


def make():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, f"{say(rng.integers(12, 30))}? {say(rng.integers(6, 14))}.") for i in range(40)]
    items += [(100, f"{say(120)}? {say(60)}."), (101, say(9)), (102, "short one?"), (103, ""), (104, None), (None, say(20)),
              (7, f"{say(18)}? {say(8)}."), (7, f"{say(18)}? {say(8)}.")]
    docs = [(k, f"{say(50)} {text} {say(70)}") for k, (_, text) in enumerate(items) if text]
    for k, (_, text) in enumerate(items):
        if text and "?" in text:
            q, a = text.split("?", 1)
            docs.append((1000 + k, f"{say(30)} {q} {say(400)} {a} {say(30)}"))  # question and answer far apart
            docs.append((2000 + k, f"{say(30)} {q} {say(100)}"))  # the question alone
            docs.append((3000 + k, f"{say(100)} {a}"))  # the answer alone
    docs += [(9001, None), (9002, ""), (9003, say(5000)), (9003, say(10)), (9004, say(30_000) + " " + items[3][1] + " " + say(30_000))]
    return docs, items


@pytest.mark.parametrize("per_index, per_pass", [(2_000, 4), (7, 2), (3, 1)])
def test_matches_brute_force(spark, per_index, per_pass):
    from ledgerwise.llm.decontaminate import contaminated

    docs, items = make()
    d = spark.createDataFrame([(*x, 0.0) for x in docs], "doc_id bigint, text string, score double").repartition(4)
    rows = contaminated(d, spark.createDataFrame(items, "item_id bigint, text string"), per_index=per_index, per_pass=per_pass).collect()
    got = {(r.doc_id, r.item_id): (r.question_overlap, r.answer_overlap) for r in rows}
    assert got == brute(docs, items) and len(rows) == len(got)
    assert (1000, 0) in got and (2000, 0) not in got and (9004, 3) in got
    scores = {(r.doc_id, r.item_id): round(r.score, 4) for r in rows}
    test_matches_brute_force.scores = getattr(test_matches_brute_force, "scores", scores)
    assert scores == test_matches_brute_force.scores  # the same whatever the number of indexes and passes


def test_empty_tables(spark):
    from ledgerwise.llm.decontaminate import contaminated

    docs, items = make()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    assert contaminated(d.limit(0), i).collect() == [] and contaminated(d, i.limit(0)).collect() == []


def test_screen_is_bounded_and_finds_the_same(monkeypatch):
    from ledgerwise.llm import decontaminate as D

    docs, items = make()
    items = [(i, t) for i, t in items if t]
    stats, texts = D.ItemStats.of([t for _, t in items]), [t or "" for _, t in docs]
    few = D.ItemIndex(items[:8], stats)
    assert few.blocks == -(-len(few.owner) // D.BLOCK) == few.peak.shape[1]  # of its own entries, not of all items'
    index, sizes = D.ItemIndex(items, stats), []
    whole = index.search(texts)
    monkeypatch.setattr(D, "CELLS", 4000)
    gathered = np.ndarray.__getitem__

    class Peak(np.ndarray):
        def __getitem__(self, key):
            out = gathered(self, key)
            sizes.append((out.shape[0], out.size))
            return out

    index.peak = index.peak.view(Peak)
    assert any(whole) and index.search(texts) == whole
    assert len(sizes) > 1 and all(n <= D.PASSAGE or cells <= D.CELLS for n, cells in sizes)
