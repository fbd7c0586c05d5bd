"""Quality rules with risk-controlled thresholds, all in DataFrame operations.

Base rules: too few words, or too many words in repeated 5-word windows.  Beyond them, three shares (symbols,
repeated lines, repeated words) get a cutoff per stratum (language), chosen on labelled documents.  A cutoff may be
used if the exact binomial tail rules out that it rejects more than ``ALPHA`` of the good documents of the stratum:
P(Bin(n, alpha) <= rejected) <= level.  Per stratum and share the cutoffs are tested from the loosest to the
strictest and the first failure ends the row (fixed-sequence testing needs no further correction); over strata and
shares the level is ``DELTA`` divided by their number (Bonferroni), and a share gets a third of ``ALPHA``.  So with
probability 1 - DELTA every stratum falsely rejects at most ALPHA of its good documents.  Too few labels: no cutoff.

Results: one row per input row.  A null text has no words; it and an empty one fail the base rules.  A null lang is
a stratum of its own.  Labels with null or repeated rows: a document counts once, as good if its largest quality
is 1.  No labels, or none in a stratum: only the base rules hold there.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions.storage import cut_lineage

WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
ALPHA, DELTA = 0.02, 0.05
#: Cutoffs in thousandths, from the loosest; a document above one is rejected.
CUTOFFS = {
    "symbols": ("try_divide(1000 * n_symbols, word_chars)", [300, 200, 150, 100, 70, 50]),
    "lines": ("try_divide(1000 * n_dup_lines, n_lines)", [900, 700, 500, 400, 300]),
    "repeats": ("try_divide(1000 * n_repeat_words, n_words)", [180, 150, 120, 100]),
}
#: Strata whose cutoffs are sent to every executor; with more, the table is joined by shuffle.
MAX_BROADCAST_STRATA = 10_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows found twice or more.  Where all windows differ that is none; else the windows are
    sorted with their places, neighbours that agree are repeats, and each adds the words up to the next, five at most."""

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, i: ((i > 0) & (x["w"] == s[F.greatest(i - 1, F.lit(0))]["w"]))
                        | ((i < F.size(s) - 1) & (x["w"] == s[F.least(i + 1, F.size(s) - 1)]["w"])))
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.least(
            F.lit(WINDOW), p[F.least(i + 1, F.size(p) - 1)] - x)).otherwise(F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(windows: Column) -> Column:
        placed = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("p")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            _let(_let(F.sort_array(placed), repeated), covered))

    # possessive and only from the start of a word, so that texts without spaces cost linear time
    ahead = "(?<![^ ])(?=(" + " ".join(["[^ ]++"] * WINDOW) + "))[^ ]++"
    windows = F.regexp_extract_all(F.array_join(words, " "), F.lit(ahead), F.lit(1))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(windows, count)).cast("bigint")


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts of every whole text, and ``n_lines`` (lines with a word)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c not in COUNTS + ["n_lines"]]
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    found = docs.select(*kept, _let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))).alias("_w"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_l"))
    return found.select(*kept, "_w.n_words", "_w.word_chars", "n_symbols", (F.col("_l.n") - F.col("_l.d")).cast("bigint").alias("n_dup_lines"),
                        "_w.n_repeat_words", F.col("_l.n").cast("bigint").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, stepped back (x >= 1; error below 1e-10)."""
    y = x + 8
    back = F.ln(x)
    for i in range(1, 8):
        back = back + F.ln(x + i)
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - back


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k): the term of k times the sum of the shrinking terms below it (1 if k >= n * p)."""
    n, k = n.cast("double"), k.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a: Column, j: Column) -> Column:
        term = a["t"] * (k - j + 1) / (n - k + j) * F.lit((1 - p) / p)
        return F.struct(term.alias("t"), (a["s"] + term).alias("s"))

    ratio = F.when(k < 1, F.lit(1.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), start, add, lambda a: a["s"]))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(top) * ratio)


def choose_cutoffs(counts: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
                   delta: float = DELTA) -> DataFrame:
    """(stratum, one column per share) of certified cutoffs; null where none is.  ``counts`` has doc_id, the stratum
    and the text counts; good documents are those with quality 1 that pass the base rules."""
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1").select("doc_id")
    passed = counts.filter(~base_failed()).join(good, "doc_id", "leftsemi")
    share = alpha / len(CUTOFFS)
    above = {f"{name}_{c}": F.count_if(F.expr(expr) > c) for name, (expr, cuts) in CUTOFFS.items() for c in cuts}
    sums = passed.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in above.items()])
    sums = cut_lineage(sums)
    level = delta / max(1, sums.count() * len(CUTOFFS))

    def strictest(name: str, cuts: list[int]) -> Column:
        chosen, open_ = F.lit(None).cast("int"), F.lit(True)
        for c in cuts:
            open_ = open_ & (binomial_tail(F.col("n"), F.col(f"{name}_{c}"), share) <= level)
            chosen = F.when(open_, F.lit(c)).otherwise(chosen)
        return chosen.alias(name)

    return sums.select("stratum", *[strictest(name, cuts) for name, (_, cuts) in CUTOFFS.items()])


def _judged(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    if cutoffs.count() <= MAX_BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    judged = counts.join(cutoffs.withColumnRenamed("stratum", "_s"), F.col("stratum").eqNullSafe(F.col("_s")), "left")
    over = F.lit(False)
    for name, (expr, _) in CUTOFFS.items():
        over = over | F.coalesce(F.expr(expr) > F.col(name), F.lit(False))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, the counts, the cutoffs of its stratum, base_failed and kept, one row per row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(stratum).alias("stratum"))
    counts = cut_lineage(text_counts(docs).drop("text"))
    cutoffs = cut_lineage(choose_cutoffs(counts, labels, "stratum"))
    return _judged(counts, cutoffs).select("doc_id", *COUNTS, "base_failed", "kept", "n_lines",
                                           *[F.col(n).alias(f"cutoff_{n}") for n in CUTOFFS])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps.  Texts are counted once and written with their counts; the cutoffs are
    chosen from the columns of counts, and no text is shuffled."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(stratum).alias("stratum"))
    counts = cut_lineage(text_counts(rows).drop("text"))
    cutoffs = cut_lineage(choose_cutoffs(counts.drop("_row"), labels, "stratum"))
    return _judged(counts, cutoffs).filter("kept").select("_row.*")
