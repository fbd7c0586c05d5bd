"""Queries of this part that SQL can express, against it."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from ledgerwise.llm.queries import ORACLE, QUERIES  # noqa: E402
from tools.compare import TABLES, norm  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == want and got
