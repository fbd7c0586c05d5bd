"""Token packing: best-fit decreasing with a segment tree over free places.

Texts become token ids with an end token.  A document longer than ``length`` is cut losslessly: full pieces are
sequences of their own, the rest is packed.  In each task the pieces are packed in blocks of ``BLOCK_TOKENS`` tokens:
longest first, each into the open sequence with the least room that suffices.  Rooms are the leaves of a segment
tree that holds the number of open sequences per room, so the search takes log2(length) steps.  No shuffle is needed,
and what a task holds is bounded by a block.

Results: one row per sequence: pack_id, doc_ids and piece numbers of its segments, cu_seqlens (from 0), ids and
positions (a matrix row of ``length``; positions restart at 0 with each segment and padding) as little-endian bytes,
ids unsigned in 16 bits if the vocabulary allows, else 32; positions in 32 bits.  Null and empty texts have the end
token only.  Repeated rows are packed as often as they occur.  An empty table gives an empty table.  Other columns
are not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
BLOCK_TOKENS = 4_000_000
TEXTS = 256


class Rooms:
    """Open sequences by free places; ``fit(n)`` takes the one with the least room of ``n`` or more."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, sequence: int, room: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def fit(self, n: int) -> tuple[int, int] | None:
        """(sequence, its room) or None."""
        i = n + self.size
        while not self.tree[i]:  # up until a subtree to the right holds one
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf
                return None
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Sequences as lists of item numbers, for items of 1 to ``length``."""
    rooms, out = Rooms(length), []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[k]
        if found := rooms.fit(n):
            at, room = found
            out[at].append(k)
        else:
            at, room = len(out), length
            out.append([k])
        if room > n:
            rooms.put(at, room - n)
    return out


def _packed(pieces: list[tuple[int, int, np.ndarray]], length: int, pad: int, kind: str) -> Iterator[tuple]:
    for group in best_fit([len(p[2]) for p in pieces], length):
        ids, pos, ends = np.full(length, pad, kind), np.zeros(length, "<i4"), [0]
        for k in group:
            seg, at = pieces[k][2], ends[-1]
            ids[at:at + len(seg)] = seg
            pos[at:at + len(seg)] = np.arange(len(seg))
            ends.append(at + len(seg))
        pos[ends[-1]:] = np.arange(length - ends[-1])
        yield [pieces[k][0] for k in group], [pieces[k][1] for k in group], ends, ids.tobytes(), pos.tobytes()


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH) -> DataFrame:
    """pack_id, doc_ids, pieces, cu_seqlens, ids, positions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        kind = "<u2" if max(end_id, *ranks.values()) < 1 << 16 else "<u4"
        next_id = TaskContext.get().partitionId() << 40
        waiting, held = [], 0
        cols = ["doc_ids", "pieces", "cu_seqlens", "ids", "positions"]

        def flush() -> pd.DataFrame:
            nonlocal next_id, waiting, held
            out = pd.DataFrame(list(_packed(waiting, length, end_id, kind)), columns=cols)
            out.insert(0, "pack_id", np.arange(next_id, next_id + len(out)))
            next_id += len(out)
            waiting, held = [], 0
            return out

        for b in batches:
            docs_, texts = b["doc_id"].tolist(), b["text"].tolist()
            for i in range(0, len(texts), TEXTS):
                for doc, text in zip(docs_[i:i + TEXTS], texts[i:i + TEXTS]):
                    ids = np.array([*enc.encode_ordinary(text or ""), end_id], kind)
                    for piece in range(-(-len(ids) // length)):
                        part = ids[piece * length:(piece + 1) * length]
                        waiting.append((doc, piece, part))
                        held += len(part)
                        if held >= BLOCK_TOKENS:
                            yield flush()
        if waiting:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "pack_id bigint, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary")


def write_packed(packs: DataFrame, path: str) -> None:
    """Write the packed matrices as Parquet, one row per sequence."""
    packs.write.mode("overwrite").parquet(path)
