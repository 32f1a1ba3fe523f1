"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py [names or prefixes]``."""

from __future__ import annotations

import collections
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            return str(value)
        return int(value) if value == int(value) and abs(value) < 2**53 else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (int, str)):
        return value
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], collections.Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, plan, sql, sf_dir):
    """Return (ok, message)."""
    df = plan(spark, sf_dir)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows={sum(got.values())} (no SQL)"
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    types = dict(zip([d[0] for d in cur.description], [str(d[1]) for d in cur.description]))
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    note = ""
    narrow = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for col, kind in df.dtypes:
        expected = narrow.get(kind)
        if expected and expected != types[col]:
            note += f" type {col}: {kind} vs {types[col]}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return False, f"rows {sum(got.values())} vs {sum(want.values())}\n   spark only {extra}\n   sql only {missing}{note}"
    return True, f"rows={sum(got.values())}{note}"


def main() -> int:
    import __spark_entry__ as entry
    from cuewright.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    plans, sqls = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, plan in plans.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            ok, message = compare(spark, con, name, plan, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the rest
            ok, message = False, "".join(traceback.format_exception_only(error))[:700]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.2f}s {message}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
