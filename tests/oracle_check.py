"""Run registered queries against their SQL: ``python tests/oracle_check.py [dir] [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """A list of differences; empty when the query and its SQL agree."""
    df = fn(spark, sf_dir)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return [f"columns {got[0]} != {want[0]}"], len(got[1])
    if got[1] == want[1]:
        return [], len(got[1])
    a, b = set(got[1]), set(want[1])
    return (
        [f"rows {len(got[1])} vs {len(want[1])}", f"only spark {sorted(a - b)[:3]}",
         f"only sql {sorted(b - a)[:3]}"],
        len(got[1]),
    )


def main():
    import __spark_entry__ as E
    from tidecast.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(cpus="8")
    con = oracle_connection(sf_dir)
    sqls = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sqls:
                problems, n = compare(spark, con, name, fn, sqls[name], sf_dir)
            else:
                problems, n = [], fn(spark, sf_dir).count()
        except Exception as e:  # noqa: BLE001
            problems, n = [f"{type(e).__name__}: {str(e)[:600]}"], 0
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind} {name:24s} {n:8d} rows "
              f"{time.time() - t:6.1f}s", *problems, sep="\n     " if problems else " ", flush=True)
        bad += bool(problems)
    print("failed:", bad)


if __name__ == "__main__":
    main()
