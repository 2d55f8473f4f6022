"""Side-by-side run of a registered query and its oracle SQL."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else ("f", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return ("t", v.isoformat())
    if v is None:
        return ("", "")
    return ("s", str(v))


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}


def compare(spark, con, build, sql: str, sf_dir: str) -> list[str]:
    """Problems found; empty when both sides agree in columns, types, row count and values."""
    df = build(spark, sf_dir)
    want_rel = con.execute(sql)
    want_cols = [d[0] for d in want_rel.description]
    want_types = {d[0]: str(d[1]) for d in want_rel.description}
    want = want_rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(want_cols):
        return [f"columns: spark {sorted(df.columns)} oracle {sorted(want_cols)}"]
    for name, typ in df.dtypes:
        if TYPES.get(want_types[name], want_types[name]) != typ:
            problems.append(f"type of {name}: spark {typ} oracle {want_types[name]}")
    order = sorted(df.columns)
    got = df.select(*[df[f"`{c}`"] for c in order]).collect()
    idx = [want_cols.index(c) for c in order]
    left = sorted(tuple(cell(v) for v in r) for r in got)
    right = sorted(tuple(cell(r[i]) for i in idx) for r in want)
    if len(left) != len(right):
        problems.append(f"rows: spark {len(left)} oracle {len(right)}")
    if left != right:
        a, b = set(left) - set(right), set(right) - set(left)
        problems.append(f"values differ ({len(a)}/{len(b)}): {order}\n   spark  {sorted(a)[:2]}\n   oracle {sorted(b)[:2]}")
    elif not left:
        problems.append("no rows on either side")
    return problems


def main(argv: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from podium.session import local_session

    sf = argv[0]
    names = argv[1:]
    sf_dir = f"{DATA}/sf{sf}"
    spark = local_session("check")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    picked = [k for k in queries if not names or any(k == n or k.startswith(n) for n in names)]
    bad = 0
    for name in picked:
        start = time.time()
        try:
            if name in oracles:
                problems = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                n = queries[name](spark, sf_dir).count()
                problems = [] if n else ["no rows"]
        except Exception as e:  # report and go on to the next query
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(problems)
        if problems or time.time() - start > 3:
            print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n  ", flush=True)
    print(f"{len(picked) - bad}/{len(picked)} ok at sf{sf}; {sum(n in oracles for n in picked)} with oracle")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
