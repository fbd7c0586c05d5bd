"""Elias-Fano n-gram trie: monotone levels in compact words, memory-mapped, searched by successor queries.

The root level holds middle words m.  Below m hang its successors w (the bigrams m w) and its predecessors v (the
contexts v m); below a context hang its trigrams.  A trigram's last word is stored as its rank among the successors
of m, a small number relative to the context, so a search first finds w below m and then that rank below v m.  Each
level is one monotone sequence: the values of a parent are shifted by the parent's base.  Pointers from parents to the
ranges of their children are monotone too.  Beside the levels lie one-byte codes of smoothed probabilities.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np

#: Bits of a word's hash below its parent.  Words that share them below one parent count as one there.
KEY_BITS = 32
_U = np.uint64


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the bit number ``rank`` (from 0) that is set in each word."""
    words, left, at = words.copy(), rank.astype(np.uint8), np.zeros(len(words), np.uint8)
    for step in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & _U((1 << step) - 1))
        over = left >= low
        left -= low * over
        moved = over * np.uint8(step)
        at += moved
        words >>= moved.astype(_U)
    return at


class EliasFano:
    """Non-falling unsigned integers: low bits packed, high bits as unary gaps with counts per word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(_U)
        n = len(v)
        top = int(v[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        high = (v >> _U(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((top >> width) + n + 2 + 63) // 64 * 64, np.uint8)
        bits[high] = 1
        words = np.packbits(bits, bitorder="little").view(_U)
        low = np.zeros((n * width + 63) // 64 + 1, _U)
        if width and n:
            part = v & _U((1 << width) - 1)
            first = np.arange(n, dtype=np.int64) * width
            word, shift = first >> 6, (first & 63).astype(_U)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[starts]] += np.add.reduceat(part << shift, starts)
            spill = np.flatnonzero(shift + _U(width) > 64)
            low[word[spill] + 1] += part[spill] >> (_U(64) - shift[spill])
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return cls(n, width, low, words, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        first = i.astype(np.int64) * self.width
        word, shift = first >> 6, (first & 63).astype(_U)
        out = self.low[word] >> shift
        over = shift + _U(self.width) > 64
        out[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return out & _U((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the positions ``i``."""
        w = np.searchsorted(self.ones, i, side="right") - 1
        bit = _select(self.high[w], i - self.ones[w]).astype(np.int64) + w * 64
        return ((bit - i).astype(_U) << _U(self.width)) | self._low(i)

    def _zero(self, h: np.ndarray) -> np.ndarray:
        """Bit behind the zero number h - 1, where the ones of the high part h begin; h of them are zeros before it."""
        out = np.zeros(len(h), np.int64)
        real = np.flatnonzero(h > 0)
        k = h[real] - 1
        w = np.searchsorted(self.zeros, k, side="right") - 1
        out[real] = _select(~self.high[w], k - self.zeros[w]).astype(np.int64) + w * 64 + 1
        return out

    def _range(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the values with the high part ``h``: a run of ones, read off its word if it ends there."""
        bit = self._zero(h)
        rest = self.high[bit >> 6] >> (bit & 63).astype(_U)
        ones = np.bitwise_count(rest & ~(rest + _U(1))).astype(np.int64)
        far = np.flatnonzero((bit & 63) + ones == 64)
        ones[far] = self._zero(h[far] + 1) - bit[far] - 1
        return bit - h, bit - h + ones

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first value >= x (n if there is none) and whether that value equals x."""
        x = x.astype(_U)
        if not self.n or not len(x):
            return np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        high = x >> _U(self.width)
        beyond = high > _U(int(self.zeros[-1]) - 1)  # no value has a higher part
        h = np.where(beyond, _U(0), high).astype(np.int64)
        lo, hi = self._range(h)
        want = x & _U((1 << self.width) - 1)
        end, open_ = hi.copy(), np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        hit = np.flatnonzero((lo < end) & ~beyond)
        same = np.zeros(len(x), bool)
        same[hit] = self._low(lo[hit]) == want[hit]
        return np.where(beyond, self.n, lo), same


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1 to 255 and their codebook (code 0: no value).

    Up to 255 different values are exact; beyond, the most frequent ones are, and a geometric grid holds the rest.
    """
    book = np.zeros(256, np.float32)
    met, counts = np.unique(values, return_counts=True)
    if len(met) > 255:
        common = met[np.argsort(-counts, kind="stable")[:127]]
        met = np.unique(np.concatenate([common, np.geomspace(met[0], met[-1], 128)]))
    book[1:len(met) + 1] = met
    middle = np.sqrt(met[1:] * met[:-1])
    return (np.searchsorted(middle, values) + 1).astype(np.uint8), book


@dataclass
class NgramTrie:
    """The levels; ``arrays`` is all that a file of them holds, ``layout`` says where."""

    roots: EliasFano  # middle words
    words: EliasFano  # successors by middle word
    word_ptr: EliasFano
    contexts: EliasFano  # predecessors by middle word
    context_ptr: EliasFano
    ranks: EliasFano  # ranks of last words by context
    bases: EliasFano  # base of each context in ``ranks``
    codes: dict[str, np.ndarray]  # words, contexts, ranks: codes, and their books

    _LEVELS = ("roots", "words", "word_ptr", "contexts", "context_ptr", "ranks", "bases")

    @classmethod
    def build(cls, roots, word_root, word_key, word_p, ctx_root, ctx_key, ctx_p, tri_ctx, tri_word, tri_p) -> NgramTrie:
        """Parallel arrays sorted by (parent, key); ``tri_word`` indexes the successors."""
        n = len(roots)
        word_ptr = np.concatenate([[0], np.cumsum(np.bincount(word_root, minlength=n))]).astype(np.int64)
        ctx_ptr = np.concatenate([[0], np.cumsum(np.bincount(ctx_root, minlength=n))]).astype(np.int64)
        bases = np.concatenate([[0], np.cumsum(np.diff(word_ptr)[ctx_root])]).astype(np.int64)
        ranks = bases[tri_ctx] + tri_word - word_ptr[ctx_root[tri_ctx]]
        codes = {}
        for name, p in (("words", word_p), ("contexts", ctx_p), ("ranks", tri_p)):
            codes[name], codes[name + "_book"] = quantise(p)
        base = lambda root, key: (root.astype(_U) << _U(KEY_BITS)) | key.astype(_U)
        sequences = (roots, base(word_root, word_key), word_ptr, base(ctx_root, ctx_key), ctx_ptr, ranks, bases)
        return cls(*map(EliasFano.build, sequences), codes)

    def arrays(self) -> list[np.ndarray]:
        out = []
        for name in self._LEVELS:
            s: EliasFano = getattr(self, name)
            out += [np.array([s.n, s.width], np.int64), s.low, s.high, s.ones]
        return out + [self.codes[c] for name in ("words", "contexts", "ranks") for c in (name, name + "_book")]

    def to_bytes(self) -> bytes:
        arrays = self.arrays()
        head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64)
        body = [head.tobytes(), *[a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays]]
        return b"".join(body)

    @classmethod
    def open(cls, raw: np.ndarray) -> NgramTrie:
        """The trie in bytes, for instance a memory map of a file."""
        n = int(raw[:8].view(np.int64)[0])
        lengths = raw[8:8 * (n + 1)].view(np.int64)
        kinds = [np.int64, _U, _U, np.int64] * len(cls._LEVELS) + [np.uint8, np.float32] * 3
        at, arrays = 8 * (n + 1), []
        for length, kind in zip(lengths.tolist(), kinds):
            size = length * np.dtype(kind).itemsize
            arrays.append(raw[at:at + size].view(kind))
            at += size + -size % 8
        levels = [EliasFano(int(h[0]), int(h[1]), *rest) for h, *rest in (arrays[i:i + 4] for i in range(0, 4 * len(cls._LEVELS), 4))]
        names = [c for name in ("words", "contexts", "ranks") for c in (name, name + "_book")]
        return cls(*levels, dict(zip(names, arrays[4 * len(cls._LEVELS):])))

    def mapped(self) -> NgramTrie:
        """The same trie, memory-mapped from a file that goes with it."""
        f = tempfile.TemporaryFile()
        f.write(self.to_bytes())
        f.flush()
        return NgramTrie.open(np.memmap(f, np.uint8, "r"))

    def root(self, key: np.ndarray) -> np.ndarray:
        """Index of middle words, -1 if unknown."""
        at, same = self.roots.successor(key)
        return np.where(same, at, -1)

    def _below(self, level: EliasFano, root: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.full(len(root), -1, np.int64)
        real = np.flatnonzero(root >= 0)
        at, same = level.successor((root[real].astype(_U) << _U(KEY_BITS)) | key[real].astype(_U))
        out[real] = np.where(same, at, -1)
        return out

    def word(self, root: np.ndarray, key: np.ndarray) -> np.ndarray:
        return self._below(self.words, root, key)

    def context(self, root: np.ndarray, key: np.ndarray) -> np.ndarray:
        return self._below(self.contexts, root, key)

    def trigram(self, root: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of the trigrams whose last word has the successor index ``word`` below the middle word."""
        out = np.full(len(root), -1, np.int64)
        real = np.flatnonzero((context >= 0) & (word >= 0))
        rank = word[real] - self.word_ptr.access(root[real]).astype(np.int64)
        at, same = self.ranks.successor(self.bases.access(context[real]) + rank.astype(_U))
        out[real] = np.where(same, at, -1)
        return out

    def code(self, level: str, index: np.ndarray) -> np.ndarray:
        """Codes of the entries, 0 for -1."""
        out = np.zeros(len(index), np.uint8)
        real = index >= 0
        out[real] = self.codes[level][index[real]]
        return out
