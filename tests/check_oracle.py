"""Run registered queries beside their SQL and compare rows.

    python tests/check_oracle.py [sf] [name ...]
"""

from __future__ import annotations

import math
import os
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [canon(v) for v in value]
    if isinstance(value, dict):
        return sorted((str(k), canon(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return canon(value.asDict())
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([canon(r[i]) for i in order]) for r in rows)), [columns[i] for i in order]


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, want_cols = rows_of(names, cur.fetchall())
    types = dict(zip([d[0] for d in cur.description], [str(d[1]) for d in cur.description]))
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        missing = sorted(set(want) - set(got))[:3]
        extra = sorted(set(got) - set(want))[:3]
        return False, f"rows {len(got)} vs {len(want)}\n  want {missing}\n  got  {extra}"
    note = "" if got else "  EMPTY"
    odd = [f"{n}:{t}" for n, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    return True, f"{len(got)} rows, {took:.1f}s{note}{'  ODD ' + str(odd) if odd else ''}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from archspark.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = args[1:]
    spark, con = local_session(os.environ.get("ORACLE_CPUS", "8")), connect(sf_dir)
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as exc:  # keep going, report at the end
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, text, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
