"""Compare catalogue queries with their SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    frame = query(spark, sf_dir)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL, {took:.1f}s"
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    want = _rows(columns, answer.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} against {sorted(columns)}"
    if got == want:
        # at the smallest scale an answer may rightly be empty in both
        return True, f"{len(got)} rows, {took:.1f}s"
    odd = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return False, f"{len(got)} against {len(want)} rows, {took:.1f}s, first differing {str(odd)[:700]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from rolesift.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, query, sqls.get(name))
        except Exception as exc:
            ok, note = False, str(exc)[:600]
        print("ok  " if ok else "FAIL", name, note, flush=True)
