"""Compare registered queries with their SQL oracle on DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return round(value, 9) + 0.0
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _key(row):
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=_key)


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=_key)
    return [columns[i] for i in order], rows


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    names, got = rows_of_spark(df)
    columns, want = rows_of_duck(con, sql)
    if names != columns:
        return f"columns {names} != {columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only spark {[r for r in got if r not in set(want)][:2]} only sql {[r for r in want if r not in set(got)][:2]}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{names}: {a} != {b}"
    return None


def main(argv):
    sys.path.insert(0, "/root/repo")
    from tallyforge.catalog import Tables, load
    from tallyforge.session import local_session

    folder = argv[0]
    wanted = argv[1:]
    spark = local_session(8)
    con = connect(folder)
    bad = 0
    for name, q in load().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = q.run(Tables(spark, folder))
            if q.sql is None:
                result = f"rows {df.count()} (no oracle)"
                print(f"ok   {name} {time.time() - start:.1f}s {result}", flush=True)
                continue
            problem = compare(df, con, q.sql)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
