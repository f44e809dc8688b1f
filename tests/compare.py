"""Runs registered queries against their SQL twins in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 7)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 7)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} / {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b and not all(
            x == y
            or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-7))
            for x, y in zip(a, b)
        ):
            return f"{a}\n   / {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from lamplight.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    good = bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            t = time.time()
            got = spark_rows(run(spark, folder))
            took = time.time() - t
            t = time.time()
            verdict = difference(got, sql_rows(con, oracles[name])) if name in oracles else "rows only"
            sql_took = time.time() - t
        except Exception as exc:  # noqa: BLE001
            verdict, took, sql_took, got = f"{type(exc).__name__}: {str(exc)[:700]}", 0, 0, ((), ())
        ok = verdict is None or verdict == "rows only"
        good, bad = good + ok, bad + (not ok)
        note = "ok" if verdict is None else verdict
        print(f"{name:34s} {len(got[1]):7d} rows {took:6.2f}s sql {sql_took:5.2f}s {note}", flush=True)
    print(f"{good} good, {bad} bad")
