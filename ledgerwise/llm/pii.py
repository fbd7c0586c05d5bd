"""Personal data: fixed patterns find seeds, and bootstrapped lexical contexts find identifiers that the patterns miss.

1. One pass finds the base entities of every whole text (email, ip, card, phone; see ``base_spans``) and other
   identifier-like tokens and joined digit groups, each with its lexical contexts: the two words before, and the word
   before with the word after; the start of a text stands for a word.
2. Contexts of seeds are patterns.  Spark scores the graph of patterns and instances in rounds: a pattern is worth
   the summed worth of its distinct instances over their number plus ``SMOOTHING``; an unknown instance that looks like a
   kind is worth 1 - product(1 - worth of its patterns) for it; a seed is worth 1 for its kind.  An instance worth
   ``TRUST`` teaches like a seed, so contexts that no seed stands in join in the next round.
3. Patterns with a worth of ``MIN_WORTH`` and with at least ``MIN_SEEDS`` distinct teachers, and ``MIN_SHARE`` of all
   seeds of their kind, are kept.  They are broadcast, the worthiest ``MAX_PATTERNS`` of each kind if there are more.
4. A second pass adds the identifier-like tokens that stand in a kept pattern and look like its kind.

Results: one row per input row.  A null text counts as empty and has no spans.  Offsets are code points, ends are
exclusive.  Repeated rows are judged alike.  Empty tables give empty tables.  Long texts are read whole, and runs of
one character class cost linear time.  Other columns are not carried by ``find_pii``; ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwise.functions.common import newest_n
from ledgerwise.functions.storage import cut_lineage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SMOOTHING = 2.0
MIN_WORTH, MIN_SEEDS, MIN_SHARE = 0.8, 5, 0.001
TRUST = 0.9
MAX_PATTERNS = 5_000

_LOCAL = "A-Za-z0-9._%+-"
#: An email begins where no local character precedes, or right behind the previous one.
_EMAIL = re.compile(rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_EMAIL_FRESH = re.compile(rf"(?<![{_LOCAL}])" + _EMAIL.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[^\s<>|\"'=,;()]++")
_HINT = re.compile(r"[0-9@]|::")
#: Digit groups joined by spaces, dots, hyphens and parentheses; a piece of WHOLE digits stands for itself.
_GROUPS = re.compile(r"(?<![\w@/])[+(]{0,2}[0-9]++(?:[ .()-]{1,3}+[0-9]++)++")
WHOLE = 10
_IPV6 = re.compile(r"[0-9A-Fa-f:.]*+")
#: Neighbouring words are looked for within so many characters; a word that does not end there gives no pattern.
REACH = 120
START = "\n"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        m = (at and _EMAIL.match(text, at)) or _EMAIL_FRESH.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted: leftmost non-overlapping matches per kind, failing ones dropped."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before; word before and word after."""
    low = max(0, start - REACH)
    words = text[low:start].rsplit(None, 2)
    if len(words) < 3:
        if low == 0:
            words = [START, *words]
        elif words and not (text[low].isspace() or text[low - 1].isspace()):
            words = words[1:]
    if not words:
        return []
    after = text[end:end + REACH].split(None, 1)
    cut = len(after) == 1 and end + REACH < len(text) and not (text[end + REACH - 1].isspace() or text[end + REACH].isspace())
    word = words[-1].lower()
    out = [f"{word} _ {after[0].lower()}"] if after and not cut else []
    return out + ([f"{words[-2].lower()} {word} _"] if len(words) > 1 else [])


def _digits(token: str) -> int:
    return sum(c in "0123456789" for c in token)


def _ipv6(token: str) -> bool:
    return len(token) <= 45 and (token.count(":") >= 3 or "::" in token) and token.strip(":.") != "" and _IPV6.fullmatch(token) is not None


def _groups(text: str) -> Iterator[tuple[int, int]]:
    """Runs of joined digit groups with 7 to 19 digits, none of whose pieces is a whole identifier."""
    for m in _GROUPS.finditer(text):
        follows = text[m.end():m.end() + 1]
        if (7 <= _digits(m[0]) <= 19 and not (follows.isalnum() or follows in ("_", "@", "/", ":") and text[m.end() + 1:m.end() + 2].isalnum())
                and (" " not in m[0] or all(_digits(x) < WHOLE for x in m[0].split(" ")))):
            yield m.span()


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifiers outside the base spans, in order: joined digit groups, and tokens with four digits or more, an at
    sign inside or the form of an IPv6 address."""
    def free(spans: Iterator[tuple[int, int]], busy: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        k = 0
        for start, end in spans:
            while k < len(busy) and busy[k][1] <= start:
                k += 1
            if k == len(busy) or busy[k][0] >= end:
                yield start, end

    def tokens() -> Iterator[tuple[int, int]]:
        for m in _RUN.finditer(text):
            found = m[0].rstrip(".:!?")
            if not _HINT.search(found):
                continue
            if _digits(found) >= 4 or "@" in found[1:-1] or _ipv6(found):
                yield m.start(), m.start() + len(found)

    base = sorted((a, b) for a, _, b in taken)
    joined = list(free(_groups(text), base))
    yield from sorted(joined + list(free(tokens(), sorted(base + joined))))


def fits(kind: int, token: str) -> bool:
    """Does a token look like its kind?"""
    digits = _digits(token)
    if kind == 0:
        return "@" in token[1:-1]
    if kind == 1:
        return " " not in token and (token.count(".") >= 3 or token.count(":") >= 3 or _ipv6(token))
    return digits >= (14 if kind == 2 else 7) and digits >= 0.6 * len(token)


def _mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text in b["text"]:
            base = base_spans(text) if text else []
            spans = [(a, z, k) for a, k, z in base]
            if text:
                spans += [(a, z, -1) for a, z in candidates(text, base)]
            for a, z, kind in spans:
                instance = xxhash.xxh3_64_intdigest(text[a:z].encode("utf-8", "surrogatepass")) - (1 << 63)
                like = sum(1 << k for k in range(len(KINDS)) if fits(k, text[a:z])) if kind < 0 else 0
                if kind >= 0 or like:
                    rows += [(p, kind, like, instance) for p in contexts(text, a, z)]
        yield pd.DataFrame(rows, columns=["pattern", "kind", "fits", "instance"])


def score_patterns(mentions: DataFrame) -> DataFrame:
    """(pattern, kind, worth) of the kept patterns from distinct (pattern, kind, fits, instance).

    kind -1 is unknown; bit k of ``fits`` tells whether the instance looks like kind k.
    """
    seeds = mentions.filter("kind >= 0")
    total = seeds.groupBy("kind").agg(F.approx_count_distinct("instance").alias("total"))
    support = cut_lineage(seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")))
    sizes = mentions.groupBy("pattern").agg(F.countDistinct("instance").alias("size")).filter(F.col("size") >= MIN_SEEDS)
    unknown = cut_lineage(mentions.filter("kind = -1").select("pattern", "instance", F.explode(F.array(*[
        F.when(F.col("fits").bitwiseAND(1 << k) != 0, F.lit(k)) for k in range(len(KINDS))])).alias("kind")).filter("kind IS NOT NULL"))

    def able(more: DataFrame) -> DataFrame:
        """Patterns with enough teachers; more: (pattern, kind, more, trusted) of unknown instances."""
        both = support.join(more, ["pattern", "kind"], "full").fillna(0, ["seeds", "more", "trusted"])
        teachers = F.col("seeds") + F.col("trusted")
        enough = both.join(F.broadcast(total), "kind").filter(  # one row per kind
            (teachers >= MIN_SEEDS) & (teachers >= MIN_SHARE * F.col("total")))
        return cut_lineage(enough.join(sizes, "pattern").select(
            "pattern", "kind", ((F.col("seeds") + F.col("more")) / (F.col("size") + SMOOTHING)).alias("worth"),
            (teachers / (F.col("size") + SMOOTHING)).alias("purity")))

    worth = able(support.select("pattern", "kind", F.lit(0.0).alias("more"), F.lit(0).cast("bigint").alias("trusted")).limit(0))
    for _ in range(ROUNDS):
        known = unknown.join(worth.select("pattern", "kind", "worth"), ["pattern", "kind"])
        found = cut_lineage(known.groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("worth", F.lit(0.999)))))).alias("value")))
        if found.isEmpty():
            break
        worth = able(unknown.join(found, ["instance", "kind"]).groupBy("pattern", "kind").agg(
            F.sum("value").alias("more"), F.count_if(F.col("value") >= TRUST).alias("trusted")))
    return worth.filter((F.col("worth") >= MIN_WORTH) & (F.col("purity") >= MIN_WORTH / 2)).select("pattern", "kind", "worth")


def learn_patterns(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Pattern -> kind number: a bounded number of high-confidence patterns (the most worthy kind of each)."""
    mentions = cut_lineage(docs.select(F.col(text_col).alias("text")).mapInPandas(
        _mentions, "pattern string, kind int, fits int, instance bigint").distinct())
    best = score_patterns(mentions).groupBy("pattern").agg(F.max("worth").alias("worth"), F.max_by("kind", F.struct("worth", -F.col("kind"))).alias("kind"))
    kept = newest_n(best, ["kind"], [F.desc("worth"), F.col("pattern")], MAX_PATTERNS)
    return {r.pattern: r.kind for r in kept.collect()}


def all_spans(text: str, base: list[tuple[int, int, int]], patterns: dict[str, int]) -> list[tuple[int, int, int]]:
    out = list(base)
    if patterns:
        for a, z in candidates(text, base):
            kind = next((k for p in contexts(text, a, z) if (k := patterns.get(p)) is not None and fits(k, text[a:z])), None)
            if kind is not None:
                out.append((a, kind, z))
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: dict[str, int] | None = None) -> DataFrame:
    """doc_id, base counts per kind, base_sha256, spans (base and discovered) and n_found, one row per row."""
    known = learn_patterns(docs, text_col) if patterns is None else patterns
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                base = base_spans(text) if text else []
                every = all_spans(text, base, shared.value) if text else []
                kinds = [k for _, k, _ in base]
                rows.append((doc, *[kinds.count(k) for k in range(4)], hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(every), len(every) - len(base)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        scan, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_found bigint")


def redact(docs: DataFrame, text_col: str = "text", patterns: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets (overlapping spans by the first one's)."""
    known = learn_patterns(docs, text_col) if patterns is None else patterns
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                if text:
                    done, parts = 0, []
                    for a, k, z in all_spans(text, base_spans(text), shared.value):
                        if a >= done:
                            parts += [text[done:a], f"<{KINDS[k]}>"]
                        done = max(done, z)
                    text = "".join(parts) + text[done:]
                out.append(text)
            yield pd.Series(out)

    return docs.withColumn(text_col, clean(F.col(text_col)))
