"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

Tier one is a broadcast table of frequent pre-tokens and their lengths in tokens.  It comes from one pass over all
texts in which every task keeps a summary of ``SUMMARY`` counters (Misra-Gries: every pre-token above
1 / SUMMARY of the task's occurrences is in it).  No pre-token is shuffled: a task hands on its summary as one packed row, and
summaries are merged ``FAN_IN`` at a time into summaries of the same size, which keeps the guarantee for all texts
together.  So the table has at most SUMMARY rows, of pre-tokens with at least ``MIN_SHARE`` of all occurrences.  Tier two
is a cache of each worker, bounded in entries and characters; what it lacks is encoded by the tokenizer library
in batches.  Table and cache move only time: a count is the same whichever tier gives it.

The special strings of the vocabulary inside a text are one token each, as the library has it by default.
Texts with characters beyond ``PLAIN`` are cut by the library's own pre-tokenizer, as Unicode tables may differ.

Results: one row per input row.  Null and empty texts have 0 bytes and 0 tokens.  An empty table gives an empty
table.  Long texts are cut and counted whole; other columns are not carried.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
SUMMARY = 50_000
MIN_SHARE = 2e-6
WORKER_CACHE, CACHE_CHARS = 400_000, 8_000_000
FAN_IN = 64
#: Letters and symbols up to here mean the same to all Unicode versions in use.
PLAIN = regex.compile(r"[\x00-ɏ‐-‧€]*")


class Counts(dict):
    """Pre-token -> tokens: the shared table first, then what this worker has met, then the library."""

    def __init__(self, path: str, pattern: str, table: dict[str, int]):
        super().__init__(table)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark fills the cores
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.table, self.cut, self.chars = table, regex.compile(pattern), 0
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special strings are pieces of their own."""
        parts = self.special.split(text) if self.special else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif PLAIN.fullmatch(part):
                out += self.cut.findall(part)
            else:
                out += [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Lengths of the pieces that are neither in the table nor met before, encoded in one batch."""
        if len(self) > len(self.table) + WORKER_CACHE or self.chars > CACHE_CHARS:
            self.clear()
            self.update(self.table)
            self.chars = 0
        new = [w for w in pieces if w not in self]
        self.chars += sum(map(len, new))
        self.update(zip(new, [len(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of every text; new pre-tokens are learnt in blocks of about a million characters."""
        out, block, chars = [], [], 0
        for text in texts:
            block.append(self.pieces(text))
            chars += len(text)
            if chars > 1_000_000:
                out, block, chars = out + self._sums(block), [], 0
        return out + self._sums(block)

    def _sums(self, block: list[list[str]]) -> list[int]:
        self.learn(set().union(*block))
        return [sum(map(self.__getitem__, p)) for p in block]


def trimmed(seen: Counter) -> Counter:
    """The largest ``SUMMARY`` counters, less the count of the next one."""
    if len(seen) <= SUMMARY:
        return seen
    floor = sorted(seen.values())[-SUMMARY - 1]
    return Counter({w: n - floor for w, n in seen.items() if n > floor})


def _packed(seen: Counter) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(json.dumps([list(seen), list(seen.values())]).encode())


def _merged(rows: pd.DataFrame) -> tuple[int, Counter]:
    """Occurrences met and the summary of several summaries."""
    seen: Counter = Counter()
    for raw in rows["summary"]:
        pieces, counts = json.loads(zstandard.ZstdDecompressor().decompress(raw))
        seen.update(dict(zip(pieces, counts)))
        if len(seen) > 2 * SUMMARY:
            seen = trimmed(seen)
    return int(rows["met"].sum()), trimmed(seen)


def frequent_pretokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """(piece, n_tokens) of pre-tokens with at least ``min_share`` of all occurrences: at most ``SUMMARY`` rows."""

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen, met = Counts(path, pattern, {}), Counter(), 0
        for b in batches:
            for text in b["t"]:
                if text:
                    pieces = counts.pieces(text)
                    met += len(pieces)
                    seen.update(pieces)
            if len(seen) > 2 * SUMMARY:
                seen = trimmed(seen)
        if met:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "met": [met], "summary": [_packed(trimmed(seen))]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        met, seen = _merged(rows)
        return pd.DataFrame({"part": [rows["part"].min()], "met": [met], "summary": [_packed(seen)]})

    def lengths(rows: pd.DataFrame) -> pd.DataFrame:
        met, seen = _merged(rows)
        pieces = [w for w, n in seen.items() if n >= met * min_share]
        counts = Counts(path, pattern, {})
        counts.learn(set(pieces))
        return pd.DataFrame({"piece": pieces, "n_tokens": [counts[w] for w in pieces]})

    kind = "part bigint, met bigint, summary binary"
    parts = docs.select(F.col(text_col).alias("t")).mapInPandas(summary, kind)
    for width in (FAN_IN, FAN_IN**2):
        parts = parts.groupBy(F.floor(F.col("part") / width)).applyInPandas(merge, kind)
    return parts.groupBy().applyInPandas(lengths, "piece string, n_tokens int")


def token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""
    rows = frequent_pretokens(docs, path, pattern, text_col).collect()  # at most SUMMARY rows
    shared = docs.sparkSession.sparkContext.broadcast({r.piece: r.n_tokens for r in rows})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(path, pattern, shared.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"],
                                "n_tokens": counts.count(list(b["t"]))})

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("t"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return out.mapInPandas(count, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > limit)
