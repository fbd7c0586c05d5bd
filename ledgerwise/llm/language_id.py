"""Language identification with word-first backoff.

A known word adds its log frequency in each language.  An unseen word falls back to its character n-grams, from five
characters down to one: the longest length at which any n-gram is known decides, with the mean of the known ones.
The language with the largest mean wins (ties: the first by name).

The model is fitted on at most ``TRAIN_DOCS`` documents per language (chosen by a hash of the id, whole texts) and
keeps words with at least ``WORD_SHARE`` of a language's words and n-grams with at least ``GRAM_SHARE`` of its n-grams
of that length, so it has at most 1 / WORD_SHARE + 5 / GRAM_SHARE entries per language and is broadcast.  More than
``MAX_LANGS`` distinct values of lang are refused.

Results: one row per input row with lang_pred and score, the winner's share after softmax of mean log frequencies
times at most ``EVIDENCE`` words.  ``und`` with score 0 for a null text or one without a letter, and for all texts if
nothing could be learned.  Repeated rows get the same answer.  Empty tables give empty tables.  Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 5_000
WORD_SHARE, GRAM_SHARE = 1e-5, 5e-5
LONGEST = 5
EVIDENCE = 20
MAX_LANGS = 1_000
WORD_CACHE = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i:i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """Model from (doc_id, text, lang) with non-null text and lang."""
    counts = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    scale = 1 << 30
    part = F.lit(False)
    for lang, n in sorted(counts.items()):
        part = part | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * min(1.0, train_docs / n))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[tuple[str, int], Counter] = defaultdict(Counter)
            for lang, text in zip(b["lang"], b["text"]):
                seen[lang, 0].update(words(text))
            for lang in {k for k, _ in seen}:
                for w, n in seen[lang, 0].items():
                    for size in range(1, LONGEST + 1):
                        for g in grams(w, size):
                            seen[lang, size][g] += n
            yield pd.DataFrame([(lang, size, u, n) for (lang, size), c in seen.items() for u, n in c.items()],
                               columns=["lang", "size", "unit", "n"])

    sums = docs.filter(part).select("lang", "text").mapInPandas(count, "lang string, size int, unit string, n bigint").groupBy(
        "lang", "size", "unit").agg(F.sum("n").alias("n")).persist()
    totals = {(r.lang, r["size"]): r.n for r in sums.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    enough = F.lit(False)
    for (lang, size), n in sorted(totals.items()):
        enough = enough | ((F.col("lang") == lang) & (F.col("size") == size) & (F.col("n") >= n * (GRAM_SHARE if size else WORD_SHARE)))
    langs = sorted({lang for lang, _ in totals})
    place = {lang: i for i, lang in enumerate(langs)}
    tables: list[dict[str, list[int]]] = [{} for _ in range(LONGEST + 1)]
    for r in sums.filter(enough).collect():
        tables[r["size"]].setdefault(r.unit, [0] * len(langs))[place[r.lang]] = r.n
    sums.unpersist()
    logs = []
    for size, table in enumerate(tables):
        base = [totals.get((lang, size), 0) + 0.5 * (len(table) + 1) for lang in langs]
        logs.append({u: np.array([math.log((n + 0.5) / b) for n, b in zip(row, base)]) for u, row in table.items()})
    return {"langs": langs, "tables": logs}


def _vector(word: str, tables: list[dict[str, np.ndarray]]) -> np.ndarray | None:
    for size in range(min(LONGEST, len(word) + 2), 0, -1):
        known = [v for g in grams(word, size) if (v := tables[size].get(g)) is not None]
        if known:
            return sum(known) / len(known)
    return None


class Scorer:
    """(language, score) of texts; remembers a bounded number of unseen words."""

    def __init__(self, model: dict):
        self.langs, self.tables, self.unseen = model["langs"], model["tables"], {}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        if len(self.unseen) > WORD_CACHE:
            self.unseen.clear()
        known, unseen, tables = self.tables[0], self.unseen, self.tables
        vectors, weights = [], []
        for w, n in Counter(words(text)).items():
            v = known.get(w)
            if v is None:
                v = unseen.get(w)
                if v is None and w not in unseen:
                    v = unseen[w] = _vector(w, tables)
            if v is not None:
                vectors.append(v)
                weights.append(n)
        if not vectors:
            return self.langs[0], 1.0 / len(self.langs)
        total = sum(weights)
        mean = np.dot(weights, np.array(vectors)) / total
        best = int(mean.argmax())
        share = np.exp((mean - mean[best]) * min(total, EVIDENCE))
        return self.langs[best], float(1.0 / share.sum())


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            found = [scorer.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id bigint, lang_pred string, score double")
