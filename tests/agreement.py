"""Compare registered queries with their SQL on DuckDB. Also runs from the command line."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _family(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return "number" if isinstance(value, (int, float)) else type(value).__name__


def rows_of(columns: list[str], records) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(rows, key=lambda r: tuple((x is None, _family(x), x if x is not None else 0) for x in r))


def differences(spark_rows, sql_rows) -> str | None:
    (left_names, left), (right_names, right) = spark_rows, sql_rows
    if left_names != right_names:
        return f"columns {left_names} against {right_names}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}; e.g. {left[:2]} against {right[:2]}"
    for a, b in zip(left, right):
        if a != b or list(map(_family, a)) != list(map(_family, b)):
            return f"{a} against {b}"
    return None


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[str | None, int]:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    return differences(mine, theirs), len(mine[1])


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry_module

    from sondeo.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry_module.oracle_sql()
    bad = 0
    for key, fn in entry_module.queries().items():
        if wanted and not any(w in key for w in wanted):
            continue
        start = time.time()
        try:
            if key in sqls:
                problem, n = compare(session, con, fn, sqls[key], sf)
            else:
                problem, n = None, len(fn(session, sf).collect())
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {key:36s} {n:7d} rows {time.time() - start:6.2f}s{'' if key in sqls else '  (no SQL)'} {problem or ''}", flush=True)
    print("disagreements:", bad)
