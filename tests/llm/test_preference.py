"""Preference formatting against plain code, with gaps in the ids and long conversations."""

import random

import pytest

pytest.importorskip("public_tokenizers")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, prompt string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def spans(turns):
    out, at = [], 0
    for r, t in turns:
        start = at + len(f"<|im_start|>{r}\n")
        at = start + len(f"{t}<|im_end|>\n")
        if r == "assistant":
            out.append((start, at))
    return out


def formatted(chosen, rejected):
    n = 0
    while n < len(chosen) and n < len(rejected) and chosen[n] == rejected[n]:
        n += 1
    return (n, render(chosen[:n]), render(chosen[n:]), spans(chosen[n:]), render(rejected[n:]), spans(rejected[n:]))


def make():
    rng = random.Random(3)
    rows = []
    for conv in rng.sample(range(10**12), 120):
        opening = rng.choice(["hi", "bye", None, f"own {conv}"])
        rows.append((conv, 0, "user", opening, "x"))
        for t in range(1, rng.randint(1, 7)):
            rows.append((conv, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "", "c d"]), "x"))
    rows += [(5, t, "user" if t % 2 == 0 else "assistant", "long " * 5000, "x") for t in range(6)]
    return rows


def grouped(rows):
    convs = {}
    for conv, turn, role, text, _ in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in sorted(convs.items())}


def shown(r):
    mask = lambda m: [(s.start, s.end) for s in m]
    return (r.n_common, r.prompt, r.chosen_completion, mask(r.chosen_mask), r.rejected_completion, mask(r.rejected_mask))


def test_foreign_replies_match_plain_code(spark):
    from ledgerwise.llm.preference import conversations, format_pairs, pairs_with_foreign_reply

    rows = make()
    convs = {c: t for c, t in grouped(rows).items() if any(r == "assistant" for r, _ in t)}
    last = {c: max(i for i, (r, _) in enumerate(t) if r == "assistant") for c, t in convs.items()}
    ids = sorted(convs)
    want = {}
    for k, c in enumerate(ids):
        other = ids[(k + 1) % len(ids)]
        want[c] = (other, *formatted(convs[c][:last[c] + 1], convs[c][:last[c]] + [convs[other][last[other]]]))
    df = conversations(spark.createDataFrame(rows, SCHEMA).repartition(7))
    got = {r.chosen_id: (r.rejected_id, *shown(r)) for r in format_pairs(pairs_with_foreign_reply(df)).collect()}
    assert got == want
    assert pairs_with_foreign_reply(df.limit(0)).collect() == []


def test_shared_first_turns_match_plain_code(spark):
    from ledgerwise.llm.preference import conversations, format_pairs, pairs_by_first_turn

    rows = make()
    convs, heads, want = grouped(rows), {}, {}
    for c, t in convs.items():
        head = heads.setdefault(t[0], c)
        if head != c:
            want[c] = (head, *formatted(convs[head], t))
    df = conversations(spark.createDataFrame(rows, SCHEMA))
    got = {r.rejected_id: (r.chosen_id, *shown(r)) for r in format_pairs(pairs_by_first_turn(df)).collect()}
    assert got == want and len(want) > 50
