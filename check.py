"""Compare registered queries with their oracle SQL in DuckDB.

usage: python check.py [sf_dir] [name-regex ...]
"""

from __future__ import annotations

import decimal
import math
import re
import sys
import time

import duckdb
from pyspark.sql import types as T

from repohealth.plans import REGISTRY
from repohealth.session import build_session
from repohealth.sources.views import BASE_TABLES

KIND = {
    T.StringType: "VARCHAR", T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE",
    T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP", T.DateType: "DATE",
}


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return f"dec{value}"
    return repr(value)


def connect(folder: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder: str, query) -> tuple[str, int]:
    df = query(spark, folder)
    got_types = {f.name: KIND.get(type(f.dataType), str(f.dataType)) for f in df.schema.fields}
    names = sorted(df.columns)
    got = sorted(tuple(canon(r[n]) for n in names) for r in df.collect())
    if not query.sql:
        return "rows only", len(got)
    cur = con.execute(query.sql)
    cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(cols) != names:
        return f"COLUMNS spark={names} oracle={sorted(cols)}", len(got)
    at = [cols.index(n) for n in names]
    want = sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())
    bad = {n: (got_types[n], want_types[n]) for n in names if got_types[n] != want_types[n]}
    if got != want:
        gs, ws = set(got), set(want)
        return (f"ROWS spark={len(got)} oracle={len(want)} names={names}\n   only spark  {sorted(gs - ws)[:3]}"
                f"\n   only oracle {sorted(ws - gs)[:3]} types {bad}"), len(got)
    if bad:
        return f"TYPES {bad}", len(got)
    return "ok", len(got)


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, query in REGISTRY.items():
        if args and not any(re.search(a, name) for a in args):
            continue
        start = time.time()
        try:
            outcome, rows = compare(spark, con, folder, query)
        except Exception as exc:  # report and go on with the next query
            outcome, rows = f"ERROR {type(exc).__name__}: {str(exc)[:900]}", -1
        flag = "" if outcome in ("ok", "rows only") else "  <<<<"
        if rows == 0:
            flag += "  (no rows)"
        failed += bool(flag.startswith("  <<<<"))
        print(f"{name:24s} {outcome} rows={rows} {time.time() - start:.1f}s{flag}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
