"""Run registered queries against their SQL: python tests/check_oracles.py [sf] [name ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from fathom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return str(value)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got[1]), None, got, None
    result = con.execute(sql)
    want = table_of([d[0] for d in result.description], result.fetchall())
    return len(got[1]), got == want, got, want


def main():
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(8), views(folder)
    bad = 0
    for name in names:
        began = time.time()
        try:
            rows, same, got, want = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"{name:26s} ERROR {str(error)[:1500]}")
            continue
        state = {None: "rows only", True: "ok", False: "DIFFERENT"}[same]
        print(f"{name:26s} {rows:8d} {state:10s} {time.time() - began:6.2f}s", flush=True)
        if same is False:
            bad += 1
            print("   columns", got[0], want[0], "rows", len(got[1]), len(want[1]))
            only = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
            for a, b in only:
                for x, y, c in zip(a, b, got[0]):
                    if x != y:
                        at = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
                        print("    ", c, "got", repr(x[max(0, at - 40) : at + 60]), "want", repr(y[max(0, at - 40) : at + 60]))
                    else:
                        print("    ", c, "same", repr(x[:60]))
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
