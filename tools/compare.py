"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

usage: python tools/compare.py SF_DIR [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def make_spark(cores: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]").appName("ledgerwise-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def norm(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else repr(round(f, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def kind(t: str) -> str:
    t = t.lower()
    for k, names in {"int": ("bigint", "int", "hugeint", "long", "smallint", "tinyint"), "float": ("double", "float", "decimal"),
                     "str": ("string", "varchar", "text"), "bool": ("bool",), "date": ("date",)}.items():
        if any(t.startswith(n) for n in names) and not t.endswith("]"):
            return k
    return t


def main() -> int:
    import duckdb

    from catalog import all_queries

    sf, picks = sys.argv[1], sys.argv[2:]
    queries, oracle = all_queries()
    spark = make_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in queries.items():
        if picks and not any(p in name for p in picks):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = sorted(df.columns)
            got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).toPandas().itertuples(index=False, name=None)) \
                if False else sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
            t1 = time.time()
            if name not in oracle:
                print(f"rows  {name:38s} {len(got):7d} rows {t1 - t0:6.2f}s", flush=True)
                continue
            cur = con.execute(oracle[name])
            names = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want_cols = sorted(names)
            idx = [names.index(c) for c in want_cols]
            want = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
            t2 = time.time()
            tdiff = [(c, t, types[c]) for c, t in df.dtypes if c in types and kind(t) != kind(types[c])]
            if cols == want_cols and got == want:
                flag = "ok   " if got else "EMPTY"
                print(f"{flag} {name:38s} {len(got):7d} rows {t1 - t0:6.2f}s sql {t2 - t1:5.2f}s"
                      + (f" TYPES {tdiff}" if tdiff else ""), flush=True)
            else:
                bad += 1
                print(f"DIFF  {name} rows {len(got)} vs {len(want)}", flush=True)
                if cols != want_cols:
                    print("   columns", cols, want_cols)
                a, b = set(got), set(want)
                for side, rows in (("spark", sorted(a - b)[:4]), ("sql", sorted(b - a)[:4])):
                    for r in rows:
                        print("  ", side, dict(zip(cols, r)))
        except Exception as e:  # keep going: report every failing query
            bad += 1
            msg = str(e).split("\n\nJVM")[0][:700]
            print(f"FAIL  {name}: {type(e).__name__}: {msg}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
