"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A text is cut into pre-tokens by the vocabulary's pattern.  The merges of a pre-token are a fold over the array of
its bytes: each step joins the leftmost pair of lowest rank, as the rank list demands.  In a rank list the rank of
a byte string is its token id, so the state of the fold holds ids only, and the ranks are looked up by the pair of
ids in a literal: the value of a one-row scalar subquery, an array of small maps, in which a lookup costs the same
however long the list is.

Distinct pre-tokens are counted once over all texts.  Those of at most ``FOLD_BYTES`` bytes with at least ``min_share``
of all occurrences (so at most ``1 / min_share`` of them, whatever the corpus) are folded once and broadcast with their
ids.  An Arrow function cuts each text, looks its pre-tokens up and merges the long tail of rare ones where they
stand, by the same pair ranks.  Both ways give the same ids; the share moves only time.

Results: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded row by row; an empty
table gives an empty table; other columns pass through, except that columns named like the outputs are replaced.
Counting cuts by Java's regular expressions, which only decides what is frequent; ids follow the cut of the ``regex``
package.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.functions.storage import cut_lineage

PAIR_BUCKETS = 1 << 18
_PAIR_FACTOR = 1_000_003
_NO_RANK = 2**31 - 1
_REST = 1 << 30  # a slice to the end
_IDS = "array<int>"
#: Longest pre-token that is folded and remembered: a step of the fold copies its arrays.
FOLD_BYTES = 256
#: Bytes of distinct tail pre-tokens whose ids one Arrow task remembers; characters of text whose tail is merged together
#: and whose ids leave the task together.
TAIL_CACHE = 2_000_000
TAIL_BLOCK = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _one_cell(spark: SparkSession, values: list, kind: pa.DataType) -> DataFrame:
    """One row whose only column ``t`` is the array ``values``: a literal for lookups."""
    return spark.createDataFrame(pa.table({"t": pa.array([values], pa.list_(kind))})).coalesce(1)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _pair(a: Column, b: Column) -> Column:
    return a * F.lit(_PAIR_FACTOR).cast("bigint") + b


def merge_pairs(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Joins the leftmost pair of lowest rank until none is left (a heap over a linked list)."""
    nxt, prev = list(range(1, len(ids))) + [-1], list(range(-1, len(ids) - 1))
    heap = [(r, i) for i in range(len(ids) - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] < 0 or j < 0 or pairs.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j] = rank, -1
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
        for left, right in ((prev[i], i), (i, nxt[i])):
            if left >= 0 and right >= 0 and (r := pairs.get((ids[left], ids[right]))) is not None:
                heapq.heappush(heap, (r, left))
    return [x for x in ids if x >= 0]


class TailMerger(dict):
    """Pre-token -> packed ids for use inside a task.  New pre-tokens of one length form a matrix of ids, in which every
    step joins the leftmost pair of lowest rank in each row: all rows shrink by one, and rows without a pair leave."""

    def __init__(self, pairs: dict[tuple[int, int], int], single: list[int]):
        super().__init__()
        self.pairs, self.single, self.held = pairs, np.array(single, np.int64), 0
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.int64, len(pairs))
        order = keys.argsort()
        self.keys, self.ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def _together(self, words: list[str], raw: list[bytes]) -> None:
        names = np.arange(len(raw))
        ids = self.single[np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)]
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        while len(ids):
            n, width = ids.shape
            low = ranks.min(1) if width > 1 else np.full(n, _NO_RANK)
            done = low == _NO_RANK
            for i, row in zip(names[done].tolist(), ids[done].astype("<u4")):
                self[words[i]] = row.tobytes()
            names, ids, ranks, low = names[~done], ids[~done], ranks[~done], low[~done]
            if not len(ids):
                break
            rows, at = np.arange(len(ids)), ranks.argmin(1)
            ids[rows, at] = low
            stay = np.ones(ids.shape, bool)
            stay[rows, at + 1] = False
            ids = ids[stay].reshape(len(rows), -1)
            stay = np.ones(ranks.shape, bool)
            stay[rows, at] = False
            ranks = ranks[stay].reshape(len(rows), -1)
            for shift in (-1, 0):
                r = rows[(at + shift >= 0) & (at + shift < ranks.shape[1])]
                c = at[r] + shift
                ranks[r, c] = self._rank(ids[r, c], ids[r, c + 1])

    def learn(self, words: set[str]) -> None:
        if self.held > TAIL_CACHE:
            self.clear()
            self.held = 0
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if w not in self:
                raw = w.encode()
                self.held += len(raw)
                by_length.setdefault(len(raw), []).append((w, raw))
        for length, group in by_length.items():
            if len(group) < 16 or length > FOLD_BYTES:
                for w, raw in group:
                    self[w] = np.array(merge_pairs(self.single[list(raw)].tolist(), self.pairs), "<u4").tobytes()
            else:
                for i in range(0, len(group), 4096):
                    self._together(*map(list, zip(*group[i:i + 4096])))

    def encode(self, texts: pa.Array, often: dict[str, bytes], cut: regex.Pattern) -> Iterator[pa.Array]:
        """Id lists of the texts, in pieces of about ``TAIL_BLOCK`` characters: no more than a piece is held or sent at once."""

        def piece(block: list[list[str]]) -> pa.Array:
            self.learn(set().union(*block).difference(often))
            packed = [b"".join([often.get(w) or self[w] for w in words]) for words in block]
            ends = np.cumsum([0, *map(len, packed)]) // 4
            flat = np.frombuffer(b"".join(packed), "<i4")
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

        block, chars = [], 0
        for t in texts:
            text = t.as_py() or ""
            block.append(cut.findall(text))
            chars += len(text)
            if chars > TAIL_BLOCK:
                yield piece(block)
                block, chars = [], 0
        yield piece(block)


class Tokenizer:
    """Encoder and decoder of one rank list and pre-token pattern."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str, min_share: float = 2e-6):
        self.pattern, self.min_share = pattern, min_share
        self._merges = {(ranks[t[:n]], ranks[t[n:]]): r for t, r in ranks.items() for n in range(1, len(t))
                        if t[:n] in ranks and t[n:] in ranks}
        self._single = [ranks[bytes([i])] for i in range(256)]
        buckets: list[list] = [[] for _ in range(PAIR_BUCKETS)]
        for (x, y), r in self._merges.items():
            key = x * _PAIR_FACTOR + y
            buckets[key % PAIR_BUCKETS].append((key, r))
        names = [""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            names[r] = t.hex()
        self._pairs = _one_cell(spark, buckets, pa.map_(pa.int64(), pa.int32()))
        self._bytes = _one_cell(spark, self._single, pa.int32())
        self._hex = _one_cell(spark, names, pa.string())
        self._le = _one_cell(spark, [i.to_bytes(4, "little").hex() for i in range(len(names))], pa.string())

    # -- encoding -----------------------------------------------------------

    def pretokens(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + self.pattern), F.lit(0))

    def _fold(self, pairs: Column, singles: Column, piece: Column) -> Column:
        """Ids of one pre-token: ranked merges folded over its bytes."""
        none = F.array().cast(_IDS)

        def rank(a: Column, b: Column) -> Column:
            return _let(_pair(a, b), lambda p: F.coalesce(pairs[(p % PAIR_BUCKETS).cast("int")][p], F.lit(_NO_RANK)))

        def merge(s: Column, low: Column) -> Column:
            ids, ranks = s["ids"], s["ranks"]
            return _let(F.array_position(ranks, low).cast("int"), lambda i: F.struct(
                F.concat(F.slice(ids, 1, i - 1), F.array(low), F.slice(ids, i + 2, F.lit(_REST))).alias("ids"),
                F.concat(
                    F.when(i > 1, F.concat(F.slice(ranks, 1, i - 2), F.array(rank(ids[i - 2], low)))).otherwise(none),
                    F.when(i < F.size(ranks), F.concat(F.array(rank(low, ids[i + 1])),
                                                       F.slice(ranks, i + 2, F.lit(_REST)))).otherwise(none)).alias("ranks")))

        def step(s: Column, _: Column) -> Column:
            return _let(F.array_min(s["ranks"]), lambda low: F.when(low < _NO_RANK, merge(s, low)).otherwise(s))

        def start(ids: Column) -> Column:
            rest = F.slice(ids, 2, F.lit(_REST))
            state = F.struct(ids.alias("ids"), F.transform(rest, lambda x, i: rank(ids[i], x)).alias("ranks"))
            return F.aggregate(rest, state, step, lambda s: s["ids"])

        chars = F.regexp_extract_all(F.hex(piece.cast("binary")), F.lit(".."), F.lit(0))
        return _let(F.transform(chars, lambda x: singles[F.conv(x, 16, 10).cast("int")]), start)

    def fold(self, words: DataFrame, word: str = "word", ids: str = "ids") -> DataFrame:
        """``words`` with the ids of every pre-token, by the fold."""
        tabled = words.withColumn("_pairs", self._pairs.scalar()).withColumn("_bytes", self._bytes.scalar())
        folded = _let(F.col("_pairs"), lambda p: _let(F.col("_bytes"), lambda b: self._fold(p, b, F.col(word))))
        return tabled.select(*words.columns, folded.alias(ids))

    def frequent(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(word, ids) of the pre-tokens with at least ``min_share`` of all occurrences."""
        words = docs.select(F.explode(self.pretokens(F.col(text))).alias("word"))
        counts = cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        often = (F.col("n") >= max(1.0, total * self.min_share)) & (F.octet_length("word") <= FOLD_BYTES)
        return self.fold(counts.filter(often).select("word"))

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``docs`` with the token ids of every text."""
        known = self.frequent(docs, text).toArrow()  # at most 1 / min_share rows
        table = {w: np.array(x, "<u4").tobytes() for w, x in zip(known["word"].to_pylist(), known["ids"].to_pylist())}
        shared = docs.sparkSession.sparkContext.broadcast((table, self._merges))
        single, pattern = self._single, self.pattern

        @F.arrow_udf("array<int>")
        def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            (often, merges), cut = shared.value, regex.compile(pattern)
            tail = TailMerger(merges, single)
            for texts in batches:
                yield from tail.encode(texts, often, cut)

        kept = [c for c in docs.columns if c != ids]
        return docs.select(*kept, look_up(F.col(text)).alias(ids))

    # -- decoding -----------------------------------------------------------

    def _joined(self, docs: DataFrame, ids: str, names: DataFrame, out: str) -> DataFrame:
        """The name of every id, in a row.  Ids and names are bound once, in one expression: the table of names must
        not become a column of its own, or Spark copies it for every row."""
        kept = [c for c in docs.columns if c not in (ids, out)]
        pieces = lambda t, x: F.unhex(F.array_join(F.transform(x, lambda i: t[i]), ""))
        both = _let(F.col("_names"), lambda t: _let(F.col(ids), lambda x: F.struct(x.alias("x"), pieces(t, x).alias("y"))))
        rows = docs.withColumn("_names", names.scalar()).select(*kept, both.alias("_s"))
        return rows.select(*kept, F.col("_s.x").alias(ids), F.col("_s.y").alias(out))

    def decode(self, docs: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """``docs`` with the bytes of every id list: the binary pieces in a row.  Null ids give null."""
        return self._joined(docs, ids, self._hex, out)

    def pack(self, docs: DataFrame, ids: str = "ids", out: str = "packed") -> DataFrame:
        """``docs`` with every id list as little-endian unsigned 32-bit integers."""
        return self._joined(docs, ids, self._le, out)
