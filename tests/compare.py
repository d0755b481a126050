"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

``python tests/compare.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """A comparable, hashable form of one value."""
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return ("num", "nan" if math.isnan(number) else number)
    if isinstance(value, dict):
        return ("map", tuple(sorted((str(k), plain(v)) for k, v in value.items())))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    return (type(value).__name__, str(value))


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, queries, checks):
    """(ok, rows, seconds, message); without SQL only the rows are counted."""
    start = time.time()
    df = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if name not in checks:
        return True, len(rows), seconds, "rows only"
    cursor = con.execute(checks[name])
    expected_columns = [d[0] for d in cursor.description]
    names, got = normalized(df.columns, rows)
    want_names, want = normalized(expected_columns, cursor.fetchall())
    if names != want_names:
        return False, len(rows), seconds, f"columns {names} != {want_names}"
    if len(got) != len(want):
        return False, len(rows), seconds, f"row counts {len(got)} != {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return False, len(rows), seconds, f"{len(bad)} rows differ, first {bad[0]}"
    return True, len(rows), seconds, "equal"


if __name__ == "__main__":
    import __spark_entry__ as spark_entry
    from logquarry.session import build_session

    session = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                            spark__driver__memory="8g", spark__log__level="ERROR")
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    all_queries, all_checks = spark_entry.queries(), spark_entry.oracle_sql()
    connection = duck(folder)
    failed = 0
    for key in sys.argv[2:] or all_queries:
        try:
            ok, n, took, note = compare(session, connection, key, folder, all_queries, all_checks)
        except Exception as error:  # keep going, report all
            ok, n, took, note = False, -1, 0.0, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key:28s} rows={n:<7d} {took:6.2f}s {note[:900]}", flush=True)
    print("failed:", failed)
    session.stop()
