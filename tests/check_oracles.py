"""Compare queries with their SQL: ``python tests/check_oracles.py [folder] [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tablecensus.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    return sorted(names), sorted(rows, key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = local_session(8)
    con = connect(folder)
    failed = []
    for name in wanted:
        started = time.time()
        got = spark_rows(entry.queries()[name](spark, folder))
        took = time.time() - started
        sql = entry.oracle_sql().get(name)
        if sql is None:
            print(f"{name:32s} {took:6.2f}s {len(got[1]):7d} rows, no SQL", flush=True)
            continue
        want = sql_rows(con, sql)
        same = got == want
        print(f"{name:32s} {took:6.2f}s {len(got[1]):7d} rows {'ok' if same else 'DIFFERS'}", flush=True)
        if not same:
            failed.append(name)
            print("  columns", got[0], want[0])
            print("  only spark", [r for r in got[1] if r not in set(want[1])][:3])
            print("  only sql", [r for r in want[1] if r not in set(got[1])][:3], len(want[1]))
    sys.exit(f"differ: {failed}" if failed else 0)
