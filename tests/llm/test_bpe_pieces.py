"""Token ids leave an Arrow task in bounded pieces, whatever the size of the batch that came in."""

import pytest

P = pytest.importorskip("public_tokenizers")


def test_ids_leave_in_pieces(monkeypatch):
    import pyarrow as pa
    import regex

    from ledgerwise.llm import bpe

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    merges = {(ranks[t[:n]], ranks[t[n:]]): r for t, r in ranks.items() for n in range(1, len(t)) if t[:n] in ranks and t[n:] in ranks}
    single = [ranks[bytes([i])] for i in range(256)]
    texts = pa.array([None, "", *(f"word{i} and zq{i * i}x don't stop" for i in range(400)), "long " * 3000, None])
    cut = regex.compile(P.PATTERN)
    encode = lambda: list(bpe.TailMerger(merges, single).encode(texts, {}, cut))
    whole = encode()
    monkeypatch.setattr(bpe, "TAIL_BLOCK", 1000)
    monkeypatch.setattr(bpe, "TAIL_CACHE", 500)
    pieces = encode()
    assert pa.concat_arrays(pieces).to_pylist() == pa.concat_arrays(whole).to_pylist() and len(whole) == 1
    assert max(len(p) for p in pieces) < 60 and sum(map(len, pieces)) == len(texts)
    assert [len(p) for p in bpe.TailMerger(merges, single).encode(texts[:0], {}, cut)] == [0]
