"""Runs registered queries beside their SQL counterparts: ``python tests/check_oracle.py [dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (decimal.Decimal, float, int)) and not isinstance(value, bool):
        return repr(round(float(value), 9))
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, x or "") for x in t))


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = queries()[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got)}"
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"FAIL columns {got_cols} / {want_cols}"
    if len(got) != len(want):
        return f"FAIL rows {len(got)} / {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, x[:300] if x else x, y[:300] if y else y) for c, x, y in zip(got_cols, g, w) if x != y]
        return f"FAIL {len(bad)} of {len(got)} rows differ, first: {diff}"
    return f"ok {len(got)}"


if __name__ == "__main__":
    from venuelens.session import build_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    session = build_session("check", master="local[8]", shuffle_partitions=8, spark__driver__memory="12g")
    session.sparkContext.setLogLevel("ERROR")
    db = connect(where)
    failed = 0
    for n in names:
        start = time.time()
        try:
            result = compare(session, db, where, n)
        except Exception as e:  # noqa: BLE001
            result = "FAIL " + type(e).__name__ + " " + str(e)[:700]
        failed += result.startswith("FAIL")
        print(f"{time.time() - start:6.2f}s {n}: {result}", flush=True)
    print("failed:", failed)
