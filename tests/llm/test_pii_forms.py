"""Spaced and bracketed identifiers, short IPv6 forms, and contexts at the start and the edge of the window."""

import time

import pytest

from ledgerwise.llm.pii import REACH, base_spans, candidates, contexts, find_pii, fits, redact


def test_candidates_of_whole_identifiers():
    for text, want in [("call (212) 555-9876 now", ["(212) 555-9876"]), ("call 212 555 9876.", ["212 555 9876"]),
                       ("card 4111 1111 1111 1112 ok", ["4111 1111 1111 1112"]), ("on 212.555.9876 x", ["212.555.9876"]),
                       ("on 2125559876 100 times", ["2125559876"]), ("at 2020-01-02 10:30", ["2020-01-02"]),
                       ("from fe80::a:b or ::ffff:abcd", ["fe80::a:b", "::ffff:abcd"]), ("std::vector a:b", []), ("1 2 3", [])]:
        assert [text[a:z] for a, z in candidates(text, base_spans(text))][:len(want) or None] == want, text
    assert list(candidates("1 " * 50_000 + "1a", [])) == []


def test_fits():
    assert fits(3, "(212) 555-9876") and fits(2, "4111 1111 1111 1112") and fits(1, "fe80::1") and not fits(1, "10:30:00")


def test_contexts():
    assert contexts("Phone: 123 x", 7, 10) == ["phone: _ x", "\n phone: _"]
    assert contexts("123 x", 0, 3) == ["\n _ x"]
    assert contexts("a b c 1 d", 6, 7) == ["c _ d", "b c _"]
    long = "w" * (REACH + 5)
    assert contexts(f"a {long} 1 {long} b", len(long) + 3, len(long) + 4) == []


@pytest.mark.parametrize("form", ["(212) 555-9876", "212 555 9876", "212-555-9876"])
def test_spaced_phones_are_found(spark, form):
    known = [(i, f"please call me on +1 (212) 555-{i:04d} thanks") for i in range(40)]
    known += [(100 + i, f"Phone: +1 (212) 556-{i:04d} today") for i in range(40)]
    rows = spark.createDataFrame(known + [(98, f"please call me on {form} thanks"), (99, f"Phone: {form} today")], "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in find_pii(rows).collect()}
    assert got[98] == f"phone:18:{18 + len(form)}" and got[99] == f"phone:7:{7 + len(form)}"
    assert {r.text for r in redact(rows).filter("doc_id > 90 AND doc_id < 100").collect()} == {"please call me on <phone> thanks", "Phone: <phone> today"}


def test_unspaced_text_costs_linear_time():
    from ledgerwise.llm.pii import base_spans, candidates

    def seconds(text):
        start = time.perf_counter()
        assert list(candidates(text, base_spans(text))) == []
        return time.perf_counter() - start

    for unit in ("a", "a.", "a::", "(", "+", "1 "):
        small, big = (seconds(unit * n) for n in (100_000, 1_000_000))
        assert big < 25 * small + 1, unit


def test_bootstrap_grows_over_rounds(spark):
    """Seeds teach one context, the identifiers found there teach another, that no seed stands in."""
    from ledgerwise.llm.pii import find_pii

    number = lambda i: f"212.555.{i:04d}"
    rows = [(i, f"please call me on +1 (212) 555-{i:04d} thanks") for i in range(60)]
    rows += [(100 + i, f"please call me on {number(i)} thanks") for i in range(20)]
    rows += [(200 + i, f"his second desk line {number(i)} rings") for i in range(20)]
    rows += [(300, f"his second desk line {number(9000)} rings"), (301, f"page of ledger {number(9001)} total"), (302, None)]
    got = {r.doc_id: r.n_found for r in find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[100] == got[200] == got[300] == 1 and got[301] == got[302] == got[0] == 0
