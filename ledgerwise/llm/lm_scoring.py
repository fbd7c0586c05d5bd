"""Language-model scores of documents by an Elias-Fano n-gram trie, learned and asked in one pass.

The model is a trigram model with interpolated absolute discounting,
p(w | u v) = max(c(u v w) - D, 0) / c(u v) + D n(u v) / c(u v) * p(w | v), the same for p(w | v), and add-one for single
words; n counts different successors, contexts that were not met hand all mass down.  All n-grams of the learning
documents are kept, so the model grows with the corpus; it is cut in tries of about ``SHARD_BYTES`` of text.

1. Each task cuts its texts into parts of about ``PART_WORDS`` words.  A part has a row for each trie: its
   distinct middle words v with their successors, predecessors and trigrams, and how often learning documents have them.
2. The task of a trie adds these lists up, builds the trie (``ngram_trie``) with discounted, quantised probabilities,
   maps it from a file, and answers each part's list entry by entry.
3. The part joins the answers with its word numbers, that wait where the first shuffle put them, and adds up its documents.

The trie of a trigram follows from its middle word.  A word that takes more than half a trie's share of all words
is split: its trigrams by their first word, its bigrams by their last word, over as many parts of tries as its share asks for.
Which words those are is guessed from at most ``SAMPLE_DOCS`` documents; the guess moves work, not results.
Counts of single words are exact (up to collisions of 64-bit hashes) and come from the same answers.

Results: one row per input row.  Words are what stands between ASCII white space, A-Z lower-cased; each text ends with
one end token, so null and empty texts have one token.  Rows with a null id or a null learning condition don't teach.  Repeated rows count each.
Without learning documents each token has probability 1 / 1.  An empty table gives an empty table.  Other columns are not
carried.  Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.llm.ngram_trie import KEY_BITS, NgramTrie
from ledgerwise.llm.textsets import mix, words

DISCOUNT = 0.75
PART_WORDS = 1_200_000
SHARD_BYTES = 8_000_000
SAMPLE_DOCS = 2_000

_U = np.uint64
_SHIFT = _U(64 - KEY_BITS)
#: No word has a space, so these are nobody's hashes.
START, END = (xxhash.xxh3_64_intdigest(w) for w in (b" start", b" end"))
_KINDS = {
    # per middle word: key (gaps), words, contexts; per word: key, count; per context: key, trigrams; per trigram: rank, count
    "ask": [_U, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.int64],
    # keys (gaps) of whole words; per middle word: count, different successors; codes and books of the levels; totals
    "answer": [_U, np.int64, np.uint32, np.uint8, np.float32, np.uint8, np.float32, np.uint8, np.float32, np.int64],
    # word numbers; words of each text, null ids, ids, held out; the split words of the part
    "plan": [np.int32, np.int64, np.uint8, np.int64, np.uint8, _U],
}


def pack(kind: str, *arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    body = [head]
    for a, k in zip(arrays, _KINDS[kind], strict=True):  # byte by byte of all values: the high bytes are mostly zero
        body.append(np.ascontiguousarray(a, k).view(np.uint8).reshape(len(a), np.dtype(k).itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1 if kind == "ask" else 3).compress(b"".join(body))


def unpack(kind: str, raw: bytes) -> list[np.ndarray]:
    raw, kinds = zstandard.ZstdDecompressor().decompress(raw), _KINDS[kind]
    at, out = 8 * len(kinds), []
    for n, k in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds):
        size = np.dtype(k).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(k).ravel())
        at += n * size
    return out


def gaps(keys: np.ndarray, kind: type = _U) -> np.ndarray:
    """Keys as differences (modulo the range of the type); small where keys rise."""
    return np.diff(keys.astype(kind), prepend=kind(0))


def whole(gap: np.ndarray) -> np.ndarray:
    return np.cumsum(gap, dtype=gap.dtype)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


class Layout:
    """The lists of a part, in the order of the tries and of the keys in them; the same wherever it is computed.

    ``hashes``: sorted hashes of the part's words, START and END; ``ids``: the words of all documents as numbers;
    ``lengths``: words of each document; ``split``: hash -> pieces of the words that are split.
    """

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, split: dict[int, int], shards: int):
        self.hashes = hashes
        start, end = np.searchsorted(hashes, np.array([START, END], _U))
        n_docs, at = len(lengths), _starts(lengths + 3)
        line = np.full(int(at[-1]), start, np.int32)  # of each document: start, start, its words, end
        inside = np.ones(len(line), bool)
        inside[at[:-1]] = inside[at[:-1] + 1] = inside[at[1:] - 1] = False
        line[inside], line[at[1:] - 1] = ids, end
        inside[at[1:] - 1] = True
        token = np.flatnonzero(inside)
        self.first, self.middle, self.last = line[token - 2], line[token - 1], line[token]
        self.doc_at = at[:-1] - 2 * np.arange(n_docs)
        self.tokens = len(token)
        del line, inside, token

        pieces = np.zeros(len(hashes), np.int64)
        keys = np.array(sorted(split), _U)
        found = np.searchsorted(hashes, keys)
        for f, k in zip(found.tolist(), keys.tolist()):
            if f < len(hashes) and hashes[f] == _U(k):
                pieces[f] = split[k]
        hot = np.flatnonzero(pieces[self.middle])
        mid = hashes[self.middle].copy()
        m = self.middle[hot]
        count = pieces[m].astype(_U)
        mid[hot] = self._piece(hashes[m], hashes[self.first[hot]] % count, 1)
        pair = self._piece(hashes[m], hashes[self.last[hot]] % count, 2)
        #: All pieces of all split words are asked for, whether the part has them or not.
        self.split_at = _starts([split[int(k)] for k in keys])
        every = np.concatenate([self._piece(np.full(split[int(k)], k, _U), np.arange(split[int(k)], dtype=_U), 2) for k in keys]) \
            if len(keys) else np.empty(0, _U)
        normal = np.zeros(len(hashes), bool)
        normal[self.middle] = True
        normal &= pieces == 0
        mids = np.unique(np.concatenate([hashes[normal], np.unique(mid[hot]), every]))
        order = np.lexsort((mids, mids % _U(shards)))
        place = np.empty(len(mids), np.int64)
        place[order] = np.arange(len(mids))
        self.mids, self.shard_at = mids[order], _starts(np.bincount((mids % _U(shards)).astype(np.int64), minlength=shards))

        def where(k: np.ndarray) -> np.ndarray:
            return place[np.searchsorted(mids, k)]

        self.split_mids, self.split_keys = where(every), keys
        self.word_mid = np.full(len(hashes), -1, np.int64)  # of words that are not split
        self.word_mid[normal] = where(hashes[normal])
        of_token = self.word_mid[self.middle].astype(np.int32)
        of_token[hot] = where(mid[hot])
        kinds = np.zeros(len(mids), np.uint8)  # 1: trigrams of a split word, 2: its bigrams
        kinds[of_token[hot]], kinds[self.split_mids] = 1, 2
        self.kinds = kinds

        key = hashes >> _SHIFT
        packed = lambda a, b: (a.astype(_U) << _U(KEY_BITS)) | b
        pair_mid = where(pair)
        entries, inv = np.unique(np.concatenate([packed(of_token, key[self.last]), packed(pair_mid, key[self.last[hot]])]),
                                 return_inverse=True)
        inv = inv.astype(np.int32)
        self.word_of, self.pair_of, self.hot = inv[:len(of_token)], inv[:len(of_token)].copy(), hot
        self.pair_of[hot] = inv[len(of_token):]  # the bigram whose probability counts
        del inv, mid
        contexts, inv = np.unique(packed(of_token, key[self.first]), return_inverse=True)
        self.context_of = inv.astype(np.int32)
        del inv, of_token
        self.word_in, self.word_key = (entries >> _U(KEY_BITS)).astype(np.int64), entries & _U((1 << KEY_BITS) - 1)
        self.context_in, self.context_key = (contexts >> _U(KEY_BITS)).astype(np.int64), contexts & _U((1 << KEY_BITS) - 1)
        tri, inv = np.unique((self.context_of.astype(np.int64) << 32) | self.word_of, return_inverse=True)
        self.trigram_of = inv.astype(np.int32)
        self.trigram_context, self.trigram_word = tri >> 32, tri & ((1 << 32) - 1)
        self.words_at = _starts(np.bincount(self.word_in, minlength=len(mids)))
        self.contexts_at = _starts(np.bincount(self.context_in, minlength=len(mids)))
        self.trigrams_at = _starts(np.bincount(self.trigram_context, minlength=len(contexts)))

    @staticmethod
    def _piece(word: np.ndarray, number: np.ndarray, kind: int) -> np.ndarray:
        return mix(word + number * _U(0x9E3779B97F4A7C15) + _U(kind))

    def asked(self, taught: np.ndarray, docs: int) -> Iterator[tuple[int, bytes]]:
        """(trie, list) of the part.  taught: is the token one of a learning document?  docs: learning documents."""
        weight = taught.astype(np.float64)
        n_words = np.bincount(self.word_of, weight, len(self.word_key))
        n_words += np.bincount(self.pair_of[self.hot], weight[self.hot], len(self.word_key))
        n_tri = np.bincount(self.trigram_of, weight, len(self.trigram_word))
        rank = self.trigram_word - self.words_at[self.word_in[self.trigram_word]]
        for s in range(len(self.shard_at) - 1):
            a, b = self.shard_at[s], self.shard_at[s + 1]
            w, c = slice(*self.words_at[[a, b]]), slice(*self.contexts_at[[a, b]])
            t = slice(*self.trigrams_at[self.contexts_at[[a, b]]])
            yield s, pack("ask", gaps(self.mids[a:b]), np.diff(self.words_at[a:b + 1]), np.diff(self.contexts_at[a:b + 1]),
                          gaps(self.word_key[w], np.uint32), n_words[w], gaps(self.context_key[c], np.uint32),
                          np.diff(self.trigrams_at[self.contexts_at[a]:self.contexts_at[b] + 1]), rank[t], n_tri[t],
                          np.concatenate([[docs if s == 0 else 0], self.kinds[a:b]]))


def _merge(root: np.ndarray, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (root, key) sorted, and the place of each pair."""
    both, inv = np.unique((root.astype(_U) << _U(bits)) | key.astype(_U), return_inverse=True)
    return (both >> _U(bits)).astype(np.int64), both & _U((1 << bits) - 1), inv


class Asked:
    """The lists of all parts for one trie, added up."""

    def __init__(self, lists: list[list[np.ndarray]]):
        self.lists = [whole(x[0]) for x in lists]
        cols = [np.concatenate(c) for c in zip(*[
            (keys, *x[1:3], whole(x[3]), x[4], whole(x[5]), *x[6:9]) for keys, x in zip(self.lists, lists)])]
        mids, n_words, n_contexts, word_key, self.n_word, context_key, n_tri, rank, self.n_tri_raw = cols
        self.docs = sum(int(x[9][0]) for x in lists)
        kinds = np.concatenate([x[9][1:] for x in lists])
        self.sizes = [(len(x[0]), len(x[4]), len(x[6]), len(x[7])) for x in lists]
        self.mids, self.mid_inv = np.unique(mids, return_inverse=True)
        self.kinds = np.zeros(len(self.mids), np.int64)
        self.kinds[self.mid_inv] = kinds
        at = np.arange(len(mids))
        word_at, list_mid = _starts(n_words), np.repeat(at, n_contexts)
        self.word_root, self.word_key, self.word_inv = _merge(self.mid_inv[np.repeat(at, n_words)], word_key, KEY_BITS)
        self.ctx_root, self.ctx_key, self.ctx_inv = _merge(self.mid_inv[list_mid], context_key, KEY_BITS)
        owner = np.repeat(np.arange(len(list_mid)), n_tri)
        word = self.word_inv[word_at[list_mid[owner]] + rank]
        self.tri_ctx, tri_word, self.tri_inv = _merge(self.ctx_inv[owner], word, 32)
        self.tri_word = tri_word.astype(np.int64)
        add = lambda inv, n, size: np.bincount(inv, n, size).astype(np.int64)
        self.words = add(self.word_inv, self.n_word, len(self.word_key))
        self.trigrams = add(self.tri_inv, self.n_tri_raw, len(self.tri_ctx))
        self.total = add(self.word_root, self.words, len(self.mids))
        self.kinds_met = add(self.word_root, self.words > 0, len(self.mids))
        self.ctx_total = add(self.tri_ctx, self.trigrams, len(self.ctx_key))
        self.ctx_kinds = add(self.tri_ctx, self.trigrams > 0, len(self.ctx_key))

    def trie(self, discount: float) -> NgramTrie:
        """Trie of what the learning documents have."""
        root, word, ctx, tri = (np.flatnonzero(x > 0) for x in (self.total, self.words, self.ctx_total, self.trigrams))
        new = lambda kept, size: np.cumsum(np.bincount(kept, minlength=size)) - 1
        to_root, to_word, to_ctx = new(root, len(self.mids)), new(word, len(self.words)), new(ctx, len(self.ctx_key))
        return NgramTrie.build(
            self.mids[root], to_root[self.word_root[word]], self.word_key[word],
            (self.words[word] - discount) / self.total[self.word_root[word]],
            to_root[self.ctx_root[ctx]], self.ctx_key[ctx], discount * self.ctx_kinds[ctx] / self.ctx_total[ctx],
            to_ctx[self.tri_ctx[tri]], to_word[self.tri_word[tri]],
            (self.trigrams[tri] - discount) / self.ctx_total[self.tri_ctx[tri]])

    def answers(self, trie: NgramTrie) -> Iterator[bytes]:
        """For each list, in its order: counts of the middle words, codes of the rest, totals of the trie."""
        root = trie.root(self.mids)
        word = trie.word(root[self.word_root], self.word_key)
        ctx = trie.context(root[self.ctx_root], self.ctx_key)
        tri = trie.trigram(root[self.ctx_root[self.tri_ctx]], ctx[self.tri_ctx], word[self.tri_word])
        by_word, by_ctx, by_tri = (trie.code(name, i) for name, i in (("words", word), ("contexts", ctx), ("ranks", tri)))
        plain = self.kinds == 0
        totals = np.array([self.total[plain].sum(), (plain & (self.total > 0)).sum(), self.docs])
        at = [0, 0, 0, 0]
        for keys, size in zip(self.lists, self.sizes):
            m, w, c, t = (inv[a:a + n] for inv, a, n in zip((self.mid_inv, self.word_inv, self.ctx_inv, self.tri_inv), at, size))
            at = [a + n for a, n in zip(at, size)]
            yield pack("answer", gaps(keys[plain[m]]), self.total[m], self.kinds_met[m], by_word[w], trie.codes["words_book"], by_ctx[c],
                       trie.codes["contexts_book"], by_tri[t], trie.codes["ranks_book"], totals)


def score_part(layout: Layout, answers: list[list[np.ndarray]], discount: float) -> dict[str, np.ndarray | int]:
    """Sums of a part's documents from the answers of all tries in order."""
    total, met = (np.concatenate([x[i] for x in answers]).astype(np.int64) for i in (1, 2))
    by_word, by_ctx, by_tri = (np.concatenate([x[i + 1][x[i]] for x in answers]).astype(np.float64) for i in (3, 5, 7))
    n_all, n_kinds, docs = sum(x[9] for x in answers).tolist()
    pieces = lambda x: np.add.reduceat(np.append(x[layout.split_mids], 0), layout.split_at[:-1]) if len(layout.split_keys) \
        else np.empty(0, np.int64)
    split_total, split_met = pieces(total), pieces(met)
    real = layout.split_keys != _U(START)
    n_all += int(split_total[real].sum()) + docs
    n_kinds += int((split_total[real] > 0).sum()) + (docs > 0)

    hashes = layout.hashes
    count, kinds = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    own = layout.word_mid >= 0
    count[own], kinds[own] = total[layout.word_mid[own]], met[layout.word_mid[own]]
    if len(layout.split_keys):
        at = np.searchsorted(hashes, layout.split_keys)
        there = np.flatnonzero((at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == layout.split_keys))
        count[at[there]], kinds[at[there]] = split_total[there], split_met[there]
        # a piece's probabilities are shares of the piece
        scale = np.ones(len(total))
        whole = np.repeat(split_total, np.diff(layout.split_at))
        scale[layout.split_mids] = total[layout.split_mids] / np.maximum(whole, 1)
        by_word = by_word * scale[layout.word_in]
    lam = np.where(count > 0, discount * kinds / np.maximum(count, 1), 1.0)
    by_ctx = np.where(by_ctx > 0, by_ctx, 1.0)
    single = count.copy()
    single[np.searchsorted(hashes, _U(END))] = docs
    base = (single + 1) / (n_all + n_kinds + 1)
    p = by_word[layout.pair_of] + lam[layout.middle] * base[layout.last]
    p = by_tri[layout.trigram_of] + by_ctx[layout.context_of] * p
    known = single[layout.last] > 0
    return {"n_known": np.add.reduceat(known.astype(np.int64), layout.doc_at), "train_tokens": n_all,
            "base": np.add.reduceat(np.log10(base)[layout.last], layout.doc_at), "score": np.add.reduceat(np.log10(p), layout.doc_at)}


class Numbers(dict):
    """Word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, numbers of all words, words of each text."""
    numbers, ids, lengths = Numbers(), [], []
    for text in texts:
        own = words(text)
        ids.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
        lengths.append(len(own))
    met = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), _U, len(numbers))
    hashes = np.unique(np.append(met, np.array([START, END], _U)))
    return hashes, np.searchsorted(hashes, met)[np.concatenate(ids)] if ids else np.empty(0, np.int64), np.array(lengths, np.int64)


def frequent(docs: DataFrame, text_col: str, shards: int, sample_docs: int, n_docs: int) -> dict[int, int]:
    """Hash -> pieces of the words with more than half a trie's share in a sample; at most 2 * shards of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(words(text))
                seen[b" start"] += 1
        yield pa.RecordBatch.from_pydict({"h": pa.array([xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in seen], pa.int64()),
                                          "n": pa.array(list(seen.values()), pa.int64())})

    scale = 1 << 30
    part = docs.select(F.col(text_col).alias("t")).filter(
        F.pmod(F.xxhash64("t"), F.lit(scale)) < int(scale * min(1.0, sample_docs / max(1, n_docs))))
    counts = part.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    all_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.filter(F.col("n") * 2 * shards > all_words).collect()
    found = {r.h + (1 << 63): -(-2 * shards * r.n // all_words) for r in rows}
    return {START: 1} | found


_ROW = "shard bigint, part bigint, payload binary"


def _lists(docs: DataFrame, split: dict[int, int], shards: int, part_words: int) -> DataFrame:
    """Rows (trie, part, list) and, with the trie -1 - part, the plan of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, texts, teach, out = zip(*held)
            hashes, numbers, lengths = _numbered(texts)
            layout = Layout(hashes, numbers, lengths, split, shards)
            teach = np.array(teach, bool)
            rows = list(layout.asked(np.repeat(teach, lengths + 1), int(teach.sum())))
            null = np.array([i is None for i in ids])
            plan = pack("plan", numbers, lengths, null, np.array([i or 0 for i in ids], np.int64), np.array(out, bool),
                        np.intersect1d(hashes, layout.split_keys))
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([-1 - part, *[s for s, _ in rows]], pa.int64()),
                "part": pa.array([part] * (len(rows) + 1), pa.int64()), "payload": pa.array([plan, *[x for _, x in rows]], pa.binary())})

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(4))):
                held.append(row)
                size += len(row[1] or "") // 6 + 1
                if size >= part_words:
                    yield flush()
                    held, size, part = [], 0, part + 1
        if held:
            yield flush()

    return docs.mapInArrow(run, _ROW)


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT,
                shard_bytes: int = SHARD_BYTES, part_words: int = PART_WORDS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows not held out."""
    found = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-found.bytes // shard_bytes))
    split = frequent(docs, text_col, shards, sample_docs, found.n)
    teach = ~held_out & F.col(id_col).isNotNull()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(teach, F.lit(False)).alias("teach"), F.coalesce(held_out, F.lit(False)).alias("held_out"))

    def answer(t: pa.Table) -> pa.Table:
        if t.column("shard")[0].as_py() < 0:
            return t.slice(0, 0)
        asked = Asked([unpack("ask", x) for x in t.column("payload").to_pylist()])
        trie = asked.trie(discount).mapped()
        return pa.Table.from_arrays([t.column("shard"), t.column("part"), pa.array(list(asked.answers(trie)), pa.binary())],
                                    ["shard", "part", "payload"])

    def score(t: pa.Table, got: pa.Table) -> pa.Table:
        if not len(got):  # the list of a trie
            return pa.Table.from_batches([], schema=result)
        numbers, lengths, null, ids, out, cut = unpack("plan", t.column("payload")[0].as_py())
        rows = sorted(zip(got.column("shard").to_pylist(), got.column("payload").to_pylist()))
        answers = [unpack("answer", x) for _, x in rows]
        # the part's words are the middle words that the tries send back, the split ones and the two marks
        hashes = np.unique(np.concatenate([*[whole(x[0]) for x in answers], cut, np.array([START, END], _U)]))
        layout = Layout(hashes, numbers.astype(np.int64), lengths, split, shards)
        sums = score_part(layout, answers, discount)
        n = len(ids)
        return pa.Table.from_arrays([
            pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(out.astype(bool)), pa.array(lengths + 1, pa.int64()),
            pa.array(sums["n_known"], pa.int64()), pa.array([sums["train_tokens"]] * n, pa.int64()),
            pa.array(sums["base"], pa.float64()), pa.array(sums["score"], pa.float64())], schema=result)

    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    # one shuffle serves the tries and, by the key of its plan, each part: the plan waits where the answers will come
    lists = _lists(rows.select("doc_id", "text", "teach", "held_out"), split, shards, part_words).repartition("shard")
    answers = lists.groupBy("shard").applyInArrow(answer, _ROW).withColumn("plan", -1 - F.col("part"))
    return lists.groupBy("shard").cogroup(answers.groupBy("plan")).applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def tries(docs: DataFrame, text_col: str = "text", discount: float = DISCOUNT, shard_bytes: int = SHARD_BYTES,
          part_words: int = PART_WORDS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(shard, words, trigrams, trie): the tries of all texts as binary rows, to be kept or opened with ``NgramTrie.open``."""
    found = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-found.bytes // shard_bytes))
    split = frequent(docs, text_col, shards, sample_docs, found.n)
    rows = docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.lit(True).alias("teach"),
                       F.lit(False).alias("held_out"))

    def build(t: pa.Table) -> pa.Table:
        trie = Asked([unpack("ask", x) for x in t.column("payload").to_pylist()]).trie(discount)
        return pa.table({"shard": t.column("shard")[:1], "words": pa.array([trie.words.n], pa.int64()),
                         "trigrams": pa.array([trie.ranks.n], pa.int64()), "trie": pa.array([trie.to_bytes()], pa.binary())})

    return _lists(rows, split, shards, part_words).filter("shard >= 0").groupBy("shard").applyInArrow(
        build, "shard bigint, words bigint, trigrams bigint, trie binary")
