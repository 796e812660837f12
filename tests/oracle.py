"""Compare registered queries with their SQL in DuckDB.

Run as a script for a table of results:
    python tests/oracle.py <folder> [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names: list[str], records) -> list[tuple]:
    """Rows with columns in name order, in a fixed row order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, name: str, folder: str, queries, oracles) -> str | None:
    """None if both sides agree, else the first difference."""
    df = queries[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return None if got else "no rows"
    cursor = con.execute(oracles[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = rows_of(names, cursor.fetchall())
    if len(got) != len(want):
        extra, lacking = set(map(repr, got)) - set(map(repr, want)), set(map(repr, want)) - set(map(repr, got))
        return f"{len(got)} rows != {len(want)}; only here {sorted(extra)[:2]}; only there {sorted(lacking)[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{sorted(names)}\n   {str(g)[:600]}\n   {str(w)[:600]}"
        for a, b in zip(g, w):
            if type(a) is not type(b) and not (a is None or b is None):
                return f"types differ: {g} {w}"
    return None


def main() -> None:
    from sparkprep.queries import ORACLES, QUERIES
    from sparkprep.session import local_session

    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con = local_session(cpus=8), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, folder, QUERIES, ORACLES)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        kind = "ok" if name in ORACLES else "rows"
        print(f"{name:34s} {time.time() - start:6.2f}s {problem or kind}", flush=True)


if __name__ == "__main__":
    main()
