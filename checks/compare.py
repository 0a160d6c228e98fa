"""Run queries in Spark and their oracle SQL in DuckDB and compare the whole results.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from checks.data import TABLES

FAMILIES = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "huge",
    "FLOAT": "float", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool",
    "TIMESTAMP": "time", "DATE": "date",
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float",
    "double": "float", "string": "text", "boolean": "bool", "timestamp_ntz": "time",
    "timestamp": "time", "date": "date",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def mismatch(df, relation) -> str | None:
    """What differs between a Spark frame and a DuckDB relation, or None."""
    ours = {n: FAMILIES.get(t, t) for n, t in df.dtypes}
    theirs = {n: FAMILIES.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types)}
    if ours != theirs:
        return f"columns {sorted(ours.items())} against {sorted(theirs.items())}"
    names = sorted(ours)
    a = Counter(map(repr, ([r[n] for n in names] for r in df.collect())))
    at = [relation.columns.index(n) for n in names]
    b = Counter(map(repr, ([r[i] for i in at] for r in relation.fetchall())))
    if a == b:
        return None
    return (f"{a.total()} rows against {b.total()}; only in Spark {list((a - b))[:4]}; "
            f"only in DuckDB {list((b - a))[:4]}")


def main() -> int:
    from checks.oracles import oracle_sql
    from checks.queries import queries
    from checks.session import session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf_dir)
    bad = 0
    sqls = oracle_sql()
    for name, query in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                problem = mismatch(df, con.sql(sqls[name]))
            else:
                problem = f"(no oracle) {df.count()} rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        verdict = "ok  " if problem is None else "----"
        bad += problem is not None and name in sqls
        print(f"{verdict} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
