"""Compare queries with their SQL: python -m tests.compare FOLDER [NAME...]; all that have SQL if no name is given."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    """A value that both engines write alike."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(x.asDict().items()))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    return int(x) if isinstance(x, (bool, int)) else x


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, folder: str) -> tuple[str, int]:
    """What differs, empty if nothing, and the number of rows."""
    df = query(spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}", sum(ours.values())
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:3]}; only in SQL {list((theirs - ours).items())[:3]}", sum(ours.values())
    return "", sum(ours.values())


def main() -> int:
    import __spark_entry__ as entry
    from tidewire.session import get_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con, queries, oracles = get_session(), connect(sys.argv[1]), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        began = time.time()
        try:
            if name in oracles:
                why, n = compare(spark, con, queries[name], oracles[name], folder)
            else:
                why, n = "", queries[name](spark, folder).count()
        except Exception as e:
            why, n = str(e)[:1500], 0
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok' if name in oracles else 'ran'} {name} {n} rows {time.time() - began:.1f} s {why}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
