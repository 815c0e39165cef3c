"""Run registered queries against their SQL in DuckDB: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerflow.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, folder):
    """Empty text when names and values agree."""
    df = query(spark, folder)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = dict(zip(names, (str(d[1]) for d in cur.description)))
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    for name, kind in df.dtypes:
        if pairs.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference: {str(g)[:400]} != {str(w)[:400]}"
    return "" if want else "no rows on either side"


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), duck(folder)
    chosen = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            text = differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], folder)
        except Exception as error:  # report and go on with the next query
            text = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(text)
        print(f"{'ok ' if not text else 'BAD'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
