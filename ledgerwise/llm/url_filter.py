"""Allow and block lists of hosts and path prefixes: a broadcast trie over reversed host labels, then path segments.

A rule fits its host and all subdomains, if the path of the url starts with the rule's path (as text).  Of the rules
that fit the longest wins: more host labels first, then the longer path; the same host and path in both lists means
block.  Where no rule fits the default verdict holds.

Results: one row per input row.  A null url, or one without "://", has an empty host and path, and only a rule with
an empty host and path would fit it.  An empty path fits rules with an empty path only.  Very long urls are walked once.
No rules: the default for all.  Other columns pass through, except that columns named like the outputs are replaced.
The trie holds at most ``MAX_RULES`` rules; longer lists are cut in tries of that size, applied one after another
with the best match carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 200_000
#: (verdict, host, path)
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, in DataFrame functions; empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    lower = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (F.coalesce(lower, F.lit("")),
            F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit("")))


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts by host label from the right; under "" a node's path trie by segment; there, under None, the
    rules whose last, open piece of path is the key."""
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault("", {})
        *segments, last = path.split("/")
        for s in segments:
            node = node.setdefault(s, {})
        ends = node.setdefault(None, {})
        if ends.get(last, ("", "allow"))[1] != "block":
            ends[last] = (host + path, verdict)
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[int, int, str, str] | None:
    """(host labels, path length, rule, verdict) of the best rule."""
    best, node, labels = None, trie, host.split(".")[::-1] if host else []
    for depth in range(len(labels) + 1):
        paths, pieces, at = node.get(""), path.split("/"), 0
        for piece in pieces:
            if paths is None:
                break
            for last, (rule, verdict) in paths.get(None, {}).items():
                if piece.startswith(last) and (best is None or (depth, at + len(last)) > best[:2]):
                    best = (depth, at + len(last), rule, verdict)
            paths, at = paths.get(piece), at + len(piece) + 1
        if depth == len(labels) or labels[depth] == "" or (node := node.get(labels[depth])) is None:
            break
    return best


def judge_urls(pages: DataFrame, rules: Iterable[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    rules, spark = list(rules), pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_match")]
    host, path = host_and_path(F.col(url_col))
    out = pages.select(*kept, host.alias("host"), path.alias("path"))
    kind = "depth int, reach int, rule string, verdict string"
    best = F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    for i in range(0, len(rules), MAX_RULES):
        shared = spark.sparkContext.broadcast(build_trie(rules[i:i + MAX_RULES]))

        @F.pandas_udf(kind)
        def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            trie = shared.value  # noqa: B023
            for hosts, paths in batches:
                found = [longest_match(trie, h, p) or (None,) * 4 for h, p in zip(hosts, paths)]
                yield pd.DataFrame(found, columns=["depth", "reach", "rule", "verdict"]).astype({"depth": "Int32", "reach": "Int32"})

        out = out.withColumn("_new", match("host", "path"))
        new = F.when(F.col("_new.depth").isNotNull(), F.col("_new"))
        out = out.withColumn("_match", new if i == 0 else F.greatest(F.col("_match"), new)).drop("_new")
    found = F.col("_match") if rules else best
    return out.select(*kept, "host", "path", found["rule"].alias("rule"),
                      F.coalesce(found["verdict"], F.lit(default)).alias("verdict"))
