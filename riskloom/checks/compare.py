"""Runs queries and their SQL side by side and compares rows, for development and tests."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb

from riskloom.checks import all_queries, all_sql


def _normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_normal(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_normal(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def compare(spark, sf: str, name: str, con=None) -> dict:
    """Result of one query: seconds, rows, and `problem` when it differs from its SQL."""
    started = time.time()
    df = all_queries()[name](spark, sf)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    names = [c.lower() for c in got_columns]
    twice = sorted({c for c in names if names.count(c) > 1}) or [c for c, kind in df.dtypes if kind in ("void", "interval")]
    if twice:
        return {"name": name, "seconds": 0, "rows": len(got), "problem": f"columns that can't be written: {twice}", "sql": name in all_sql()}
    out = {"name": name, "seconds": round(time.time() - started, 2), "rows": len(got), "problem": None, "sql": False}
    sql = all_sql().get(name)
    if sql is None:
        return out
    out["sql"] = True
    result = (con or duck(sf)).execute(sql)
    want_columns = [d[0] for d in result.description]
    want_types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    got_columns, got = _rows(got_columns, got)
    want_columns, want = _rows(want_columns, want)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = {"bigint": ("BIGINT", "NUMBER"), "int": ("INTEGER", "NUMBER"), "string": ("VARCHAR", "STRING"), "double": ("DOUBLE", "NUMBER"),
             "boolean": ("BOOLEAN", "bool"), "timestamp": ("TIMESTAMP", "DATETIME"), "timestamp_ntz": ("TIMESTAMP", "DATETIME")}
    odd = [(c, types[c], want_types.get(c)) for c in types if want_types.get(c) not in pairs.get(types[c], ())]
    if got_columns != want_columns:
        out["problem"] = f"columns {got_columns} / {want_columns}"
    elif len(got) != len(want):
        out["problem"] = f"rows {len(got)} / {len(want)}"
        a, b = set(map(repr, got)), set(map(repr, want))
        out["problem"] += f" only spark {sorted(a - b)[:2]} only sql {sorted(b - a)[:2]}"
    elif got != want:
        bad = next((g, w) for g, w in zip(got, want) if g != w)
        out["problem"] = f"values {bad[0]} / {bad[1]}"
    elif odd:
        out["problem"] = f"types {odd}"
    if not out["problem"] and not got:
        out["problem"] = "no rows"
    return out


def main(argv) -> int:
    from riskloom.session import local_session

    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("checks")
    names = argv or list(all_queries())
    if len(names) == 1 and names[0].endswith("*"):
        names = [n for n in all_queries() if n.startswith(names[0][:-1])]
    con, bad = duck(sf), 0
    for name in names:
        try:
            r = compare(spark, sf, name, con)
        except Exception as problem:
            r = {"name": name, "seconds": 0, "rows": -1, "sql": True, "problem": str(problem)[:1500]}
        bad += bool(r["problem"])
        flag = "BAD " if r["problem"] else "ok  "
        print(f"{flag}{r['seconds']:7.2f}s {r['rows']:8d} {'sql ' if r['sql'] else 'rows'} {name} {r['problem'] or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    import sys
    sys.exit(main(sys.argv[1:]))
