"""Benchmark decontamination: a BM25 index of the test items, queried with every training passage by block-max WAND.

The items are indexed: per term a posting list of (item, impact), cut in blocks of ``BLOCK`` items with their largest
impact.  An impact is the BM25 weight of the term in the item divided by the sum of the item's weights, so a score is
the share of the item's weight that a passage holds.  Every document is cut in passages of ``PASSAGE`` words, one
every half passage; each is a query, and all items with a score of ``THRESHOLD`` or more are retrieved: no top-k.
The largest impacts bound what a passage can reach in each block of items; only where the bound allows it are posting
lists walked, pivot by pivot.  A retrieved item is verified on the words of the document: the item's question and its
answer (the last sentence, or the last third if there is one sentence) must each have enough of their word 5-grams
in the document (``OVERLAP`` of them; parts shorter than five words are one gram).

Items longer than half a passage are indexed by windows of half a passage; so is the question of each item on its own, as a
document may hold it far from the answer.  A hit of any of an item's entries leads to the verification of the whole item, and
no item is verified without its question, so answers need no entries.  An index has at most ``ITEMS`` items and a pass over
the documents at most ``INDEXES`` of them, so what is broadcast is bounded; document frequencies and the mean length are
those of all items, so results don't depend on the number of indexes or passes.

Results: one row (doc_id, item_id, score, question_overlap, answer_overlap) per verified pair; documents without one
have no row.  Null or empty texts and items match nothing.  Repeated rows give one match per distinct
(doc_id, item_id); of items with equal id and different texts each is verified, and the largest figures stay.  Empty tables give an empty result.  Words are runs of letters and digits, lower-cased.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions.storage import cut_lineage

PASSAGE = 128
THRESHOLD = 0.6
OVERLAP = 0.75
GRAM = 5
BLOCK = 8
ITEMS, INDEXES = 2_000, 4
#: Largest impacts that one step of the screen gathers: passages are taken together up to this many (a passage is never split).
CELLS = 4_000_000
K1, B = 1.2, 0.75
_END = 1 << 60
_at = itemgetter(0)
_WORD = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence, or else the last third."""
    parts = [p for p in map(tokens, re.split(r"(?<=[.?!])\s+|\n+", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = tokens(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def entries_of(text: str) -> list[list[str]]:
    """What an item is found by: windows of half a passage of its words, and of its question's words."""
    half = PASSAGE // 2
    out = [words[i:i + half] for words in (tokens(text), question_and_answer(text)[0]) if words
           for i in range(0, max(1, len(words) - half // 2), half // 2)]
    return [list(e) for e in dict.fromkeys(map(tuple, out))]


class ItemStats:
    """Entries of all items: their number, summed length and, per term, how many have it."""

    def __init__(self, n: int, length: int, seen: dict[str, int]):
        self.n, self.length, self.seen = n, length, seen

    @classmethod
    def of(cls, texts: list[str]) -> ItemStats:
        entries = [e for t in texts for e in entries_of(t)]
        return cls(len(entries), sum(map(len, entries)), Counter(w for e in entries for w in set(e)))


class ItemIndex:
    """BM25 index over one block of test items; an item is known by its row, as ids may repeat."""

    def __init__(self, items: list[tuple[int, str]], stats: ItemStats | None = None):
        stats = stats or ItemStats.of([text for _, text in items])
        self.ids = [item for item, _ in items]
        self.items = [question_and_answer(text) for _, text in items]
        entries = [(row, words) for row, (_, text) in enumerate(items) for words in entries_of(text)]
        entries.sort(key=lambda e: len(e[1]))  # items of like length share a block, so its bound is tight
        self.owner = [row for row, _ in entries]
        n, mean = stats.n, stats.length / max(stats.n, 1)
        df = stats.seen
        seen = dict.fromkeys(w for _, words in entries for w in words)
        self.terms = {w: i for i, w in enumerate(seen)}
        self.blocks = -(-len(entries) // BLOCK)
        self.peak = np.zeros((len(seen), self.blocks), np.float32)
        self.postings: list[dict[int, tuple[list[int], list[float]]]] = [{} for _ in seen]  # term -> block -> entries, impacts
        for e, (_, words) in enumerate(entries):
            weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1)
                      / (tf + K1 * (1 - B + B * len(words) / mean)) for w, tf in Counter(words).items()}
            total, block = sum(weight.values()), e // BLOCK
            for w, x in weight.items():
                t = self.terms[w]
                ends, impacts = self.postings[t].setdefault(block, ([], []))
                ends.append(e)
                impacts.append(x / total)
                self.peak[t, block] = max(self.peak[t, block], x / total)

    def wand(self, query: list[int], block: int) -> list[tuple[int, float]]:
        """(entry, score) of all entries of a block that reach the threshold, given that its maxima do."""
        lists = []
        for t in query:
            if (posting := self.postings[t].get(block)) is not None:
                lists.append([posting[0][0], 0, posting[0], posting[1], max(posting[1])])
        found = []
        while lists:
            lists.sort(key=_at)
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[4]
                if bound >= THRESHOLD - 1e-6:
                    pivot = x[0]
                    break
            if pivot is None:
                break
            if lists[0][0] == pivot:
                score = 0.0
                for x in lists:
                    if x[0] != pivot:
                        break
                    score += x[3][x[1]]
                if score >= THRESHOLD - 1e-6:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for x in lists:
                if x[0] >= target:
                    break
                x[1] = bisect_left(x[2], target, x[1])
                x[0] = x[2][x[1]] if x[1] < len(x[2]) else _END
            lists = [x for x in lists if x[0] < _END]
        return found

    def search(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """Per text the (row, best score) of all items that one of its passages retrieves."""
        none, half = len(self.terms), PASSAGE // 2
        split = [tokens(t) for t in texts]
        sizes = np.array([len(w) for w in split])
        cells = np.maximum(1, -(-sizes // half))  # half passages of each text
        first = np.r_[0, np.cumsum(cells)]
        t = np.array(list(map(self.terms.get, chain.from_iterable(split), repeat(none))), np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        cell = (np.arange(len(t)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // half + first[doc]
        known = t < none
        t, doc, cell = t[known], doc[known], cell[known]
        # passage c has the half passages c and c + 1; the last half passage is one of its own only if it is the first
        own, before = (cell < first[doc + 1] - 1) | (cells[doc] == 1), cell > first[doc]
        pairs = np.unique(np.r_[cell[own] * none + t[own], (cell[before] - 1) * none + t[before]])
        passage, terms = pairs // max(none, 1), pairs % max(none, 1)
        starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(pairs) else []
        hits: list[dict[int, float]] = [{} for _ in texts]
        i, room = 0, CELLS // max(self.blocks, 1)
        while i < len(starts):
            after = min(max(i + 1, int(np.searchsorted(starts, starts[i] + room, "right")) - 1), i + 1024)
            part, end = starts[i:after], starts[after] if after < len(starts) else len(pairs)
            i = after
            bound = np.add.reduceat(self.peak[terms[part[0]:end]], part - part[0], axis=0)
            for r, block in zip(*map(np.ndarray.tolist, np.nonzero(bound >= THRESHOLD - 1e-4))):
                stop = part[r + 1] if r + 1 < len(part) else end
                d = int(np.searchsorted(first, passage[part[r]], "right")) - 1
                for e, score in self.wand(terms[part[r]:stop].tolist(), block):
                    hits[d][self.owner[e]] = max(score, hits[d].get(self.owner[e], 0.0))
        return [sorted(h.items()) for h in hits]

    def verify(self, text: str, row: int) -> tuple[float, float]:
        """Shares of the question's and the answer's grams that the text has."""
        words = tokens(text)
        shares = []
        for part in self.items[row]:
            want = grams(part)
            n = len(next(iter(want))) if want else 0
            have = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()
            shares.append(len(want & have) / len(want) if want else 1.0)
        return shares[0], shares[1]


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"term": sorted({w for t in b["t"] for w in tokens(t)})})


def item_stats(items: DataFrame) -> tuple[int, int, DataFrame]:
    """Number and summed length of all entries of the items (i, t), and (term, df)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            stats = ItemStats.of(b["t"].tolist())
            yield pd.DataFrame([*stats.seen.items(), (None, stats.n), (None, stats.length)], columns=["term", "n"]).assign(
                kind=[0] * len(stats.seen) + [1, 2])

    rows = cut_lineage(items.mapInPandas(count, "term string, n bigint, kind int").groupBy("kind", "term").agg(F.sum("n").alias("n")))
    whole = {r.kind: r.n for r in rows.filter("kind > 0").collect()}
    return whole.get(1, 0), whole.get(2, 0), rows.filter("kind = 0").select("term", F.col("n").alias("df"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", per_index: int = ITEMS, per_pass: int = INDEXES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every document and item that match."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    items = cut_lineage(items.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter(
        "t IS NOT NULL AND i IS NOT NULL").distinct())
    n, length, frequency = item_stats(items)
    blocks = max(1, -(-items.count() // per_index))
    placed = items.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int"))
    kind = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    out = None
    for first in range(0, blocks, per_pass):
        part = placed.filter(F.col("k").between(first, first + per_pass - 1))
        texts = [(r.k, r.i, r.t) for r in part.orderBy("k", "i", "t").collect()]  # about per_index * per_pass items
        found = {r.term: r.df for r in frequency.join(part.mapInPandas(_terms, "term string").distinct(), "term", "left_semi").collect()}
        shared = spark.sparkContext.broadcast((texts, n, length, found))

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            texts, n, length, df = shared.value  # noqa: B023
            by_index: dict[int, list[tuple[int, str]]] = {}
            for k, i, t in texts:
                by_index.setdefault(k, []).append((i, t))
            indexes = [ItemIndex(own, ItemStats(n, length, df)) for own in by_index.values()]
            for b in batches:
                hits, ids, texts = [], b["doc_id"].tolist(), b["text"].tolist()
                for index in indexes:
                    for i in range(0, len(ids) if index.blocks else 0, 512):
                        for doc, text, near in zip(ids[i:i + 512], texts[i:i + 512], index.search(texts[i:i + 512])):
                            for row, score in near:
                                q, a = index.verify(text, row)
                                if q >= OVERLAP and a >= OVERLAP:
                                    hits.append((doc, index.ids[row], score, q, a))
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        one = rows.mapInPandas(match, kind)
        out = one if out is None else out.union(one)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
