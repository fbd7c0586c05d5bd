"""Near-duplicate documents: MinHash bands propose pairs, odd sketches screen them, full sets confirm them.

1. One pass over the texts gives each document the hash of its whole shingle set, ``BANDS`` band keys of ``ROWS``
   MinHash values each, and an odd sketch: the parity bitmap of all samples, in which the XOR of two sketches
   counts the samples that differ.
2. Documents with equal sets become one class; only the smallest id of a class goes on.
3. In a bucket (documents with a common band key) every member meets one centre, not every other member.  Members
   that end in another component than the rest of their bucket meet further, random centres.
4. What is still apart then is compared across components.  Let a shingle be rare if at most ``RARE`` of these
   documents have it.  A linked pair either shares a rare shingle, and an index of the rare ones finds it with at most
   ``RARE`` partners per entry; or it shares only common ones, and then its union holds the rare shingles of both:
   100 * min(c) >= 75 * (r + r' + max(c)) for r rare and c common shingles of each.  That bound is exact and
   compares cells of equal counts of a bucket, so documents of one template that are all a little too different meet once and
   not pair by pair.  So no link between different components of a bucket stays untested, and a group of
   thousands of copies costs a few pairs each.
5. A pair whose sketches agree enough is confirmed on both full sets: 100 * |A and B| >= 75 * |A or B|.

A link at the limit of 0.75 shares none of the 32 bands with probability 5e-6 and fails the sketch with
2.2e-7; links of higher similarity fail far more seldom.

Results: one row per input row.  A null or empty text, or one without words, has an empty set and is its own
component.  Fewer than five words are one shingle.  Repeated rows of one doc_id give repeated rows.  An empty table
gives an empty table.  Columns of the input other than id and text are not carried.  Long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions.storage import cut_lineage
from ledgerwise.llm.textsets import WordHashes, mix, shingle_set
from ledgerwise.operators.graph import connected_components

BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: Estimated similarity from which a pair is confirmed: the limit less six deviations of 128 samples.
SCREEN = 0.5
PERCENT = 75
#: Rounds with a further random centre for buckets of several components; the exact step after them grows cheaper.
PIVOTS = 1
#: A shingle that at most so many of the compared documents have is rare.
RARE = 8

_SAMPLES = BANDS * ROWS
_A = mix(np.arange(1, _SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(np.arange(1, _SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_SALT = mix(np.arange(1, _SAMPLES + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def min_hashes(items: np.ndarray, block: int = 512) -> np.ndarray:
    low = np.full(_SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), block):
        np.minimum(low, (items[i:i + block, None] * _A + _B).min(0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> bytes:
    bits = np.bincount((mix(samples ^ _SALT) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def similar_enough(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Screen: the similarity that two odd sketches suggest is at least ``SCREEN``."""
    x = np.frombuffer(b"".join(left), np.uint64) ^ np.frombuffer(b"".join(right), np.uint64)
    odd = np.bitwise_count(x.reshape(len(left), -1)).sum(1)
    rest = np.maximum(1e-9, 1 - 2 * odd / SKETCH_BITS)
    return 1 + SKETCH_BITS / (4 * _SAMPLES) * np.log(rest) >= SCREEN


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"], batch["text"]):
            s = shingle_set(text, hashes)
            if len(s):
                low = min_hashes(s)
                band = mix(low.reshape(BANDS, ROWS) @ _A[:ROWS] + _B[:BANDS])
                rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), band.view(np.int64).tolist(), odd_sketch(low)))
            else:
                rows.append((doc, 0, None, [], None))
        yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_key", "bands", "sketch"])


def _screened(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, sa, sb) that pass the screen."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.loc[similar_enough(p["sa"], p["sb"]) if len(p) else [], ["a", "b"]]

    return pairs.mapInPandas(keep, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, s = WordHashes(), None, None
        for p in batches:
            kept = []
            for a, b, ta, tb in zip(p["a"], p["b"], p["ta"], p["tb"]):
                if a != last:
                    last, s = a, shingle_set(ta, hashes)
                t = shingle_set(tb, hashes)
                both = len(np.intersect1d(s, t, assume_unique=True))
                kept.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            yield p.loc[kept, ["a", "b"]]

    full = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    full = full.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInPandas(check, "a bigint, b bigint")


def _postings(batches: Iterator[pd.DataFrame], rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """(doc_id, h): each shingle of each document."""
    hashes = WordHashes()
    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"]):
            s = shingle_set(text, hashes).view(np.int64)
            for i in range(0, len(s), rows):
                yield pd.DataFrame({"doc_id": doc, "h": s[i:i + rows]})


def _across(rest: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of different components of a bucket that may be linked.  rest: key, doc_id, comp."""
    nodes = cut_lineage(rest.select("doc_id", "comp").distinct().join(reps.select("doc_id", "n_shingles"), "doc_id"))
    postings = cut_lineage(texts.join(nodes.select("doc_id"), "doc_id").mapInPandas(_postings, "doc_id bigint, h bigint"))
    known = postings.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = cut_lineage(postings.join(known, "h"))

    def side(df: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
        return df.select(key, *[F.col(c).alias(d) for c, d in names.items()])

    listed = shared.filter(F.col("df") <= RARE).select("h", "doc_id").join(nodes, "doc_id")
    left = side(listed, "h", {"doc_id": "a", "comp": "ca", "n_shingles": "na"})
    right = side(listed, "h", {"doc_id": "b", "comp": "cb", "n_shingles": "nb"})
    sizes = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    by_rare = left.join(right, (left["h"] == right["h"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sizes)

    common = shared.filter(F.col("df") > RARE).groupBy("doc_id").agg(F.count(F.lit(1)).alias("common"))
    counted = nodes.join(common, "doc_id").select("doc_id", "common", (F.col("n_shingles") - F.col("common")).alias("rare"))
    counted = counted.filter(100 * F.col("common") >= PERCENT * (F.col("rare") + F.col("common")))
    placed = cut_lineage(rest.select("key", "doc_id", "comp").join(counted, "doc_id").join(reps.select("doc_id", "bands"), "doc_id"))
    # the largest component of a bucket is only met by the others, who meet among themselves by order
    top = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"))
    others = cut_lineage(placed.join(top, "key").filter("comp <> top"))
    left = side(others, "key", {"doc_id": "a", "comp": "ca", "common": "na", "rare": "ra", "bands": "ka", "top": "top"})
    right = side(placed, "key", {"doc_id": "b", "comp": "cb", "common": "nb", "rare": "rb", "bands": "kb"})
    bound = 100 * F.least("na", "nb") >= PERCENT * (F.col("ra") + F.col("rb") + F.greatest("na", "nb"))
    # the bound is a matter of the two counts, so cells of equal counts are compared first and only cells that may hold
    # links meet member by member
    cell_a = side(others.select("key", "common", "rare").distinct(), "key", {"common": "na", "rare": "ra"})
    cell_b = side(placed.select("key", "common", "rare").distinct(), "key", {"common": "nb", "rare": "rb"})
    allowed = cut_lineage(cell_a.join(cell_b, "key").filter(bound))
    once = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")  # a pair counts in one of its buckets
    met = (F.col("cb") == F.col("top")) | (F.col("ca") < F.col("cb"))
    by_common = left.join(allowed, ["key", "na", "ra"]).join(right, ["key", "nb", "rb"]).filter((F.col("ca") != F.col("cb")) & met & once)
    return by_rare.select("a", "b").union(by_common.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id)."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = cut_lineage(docs.mapInPandas(
        _signatures, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary"))
    filled = sigs.filter("n_shingles > 0")
    classes = cut_lineage(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    reps = filled.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "leftsemi")
    reps = cut_lineage(reps.select("doc_id", "n_shingles", "bands", "sketch").dropDuplicates(["doc_id"]))

    member = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = cut_lineage(member.groupBy("key").agg(F.min("doc_id").alias("center"), F.count(F.lit(1)).alias("n"))
                         .filter("n > 1").select("key", "center"))
    member = cut_lineage(member.join(shared, "key").select("key", "doc_id", "center"))
    nodes = cut_lineage(member.select("doc_id").distinct())
    texts = cut_lineage(docs.join(nodes, "doc_id").dropDuplicates(["doc_id"]))
    sketches = reps.join(nodes, "doc_id", "leftsemi").select("doc_id", "sketch")

    def sketched(pairs: DataFrame) -> DataFrame:
        return pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), "a").join(
            sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb")), "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return cut_lineage(_confirmed(cut_lineage(_screened(sketched(pairs.distinct()))), texts))

    def apart(comps: DataFrame, seed: int) -> DataFrame:
        """Members (key, doc_id, comp) of the buckets that hold more than one component, with a pivot by the seed."""
        placed = member.select("key", "doc_id").join(comps, "doc_id", "left").select(
            "key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
        order = F.xxhash64("doc_id", F.lit(seed))
        mixed = cut_lineage(placed.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min_by("doc_id", order).alias("pivot"), F.min_by("comp", order).alias("pivot_comp"))
            .filter("lo < hi").select("key", "pivot", "pivot_comp"))
        return cut_lineage(placed.join(mixed, "key"))

    def components(links: DataFrame) -> DataFrame:
        return cut_lineage(connected_components(links).select(F.col("wallet").alias("doc_id"), "component"))

    links = confirmed(member.filter("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")))
    for seed in range(PIVOTS):
        # the least linked id stands for the component here: finer, so no pair is passed over
        ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        stars = ends.groupBy(F.col("e.b").alias("doc_id")).agg(F.least(F.min("e.a"), F.first("e.b")).alias("component"))
        rest = apart(stars, seed)
        if rest.isEmpty():
            break
        links = cut_lineage(links.union(confirmed(rest.filter("comp <> pivot_comp").select(
            F.col("pivot").alias("a"), F.col("doc_id").alias("b")))))
    comps = components(links)
    rest = apart(comps, PIVOTS)
    if not rest.isEmpty():
        more = confirmed(_across(rest, reps, texts))
        if not more.isEmpty():
            comps = components(links.union(more))

    comps = comps.withColumnRenamed("doc_id", "rep")
    named = cut_lineage(classes.join(comps, "rep", "left").filter("n > 1 OR component IS NOT NULL").select(
        "set_key", F.coalesce("component", "rep").alias("component")))
    out = sigs.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id"))
