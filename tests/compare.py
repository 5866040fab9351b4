"""Compare registered queries with their SQL; also runnable as a script."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    if value is None:
        return "\0"
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    if isinstance(value, dict):
        return str({k: canonical(v) for k, v in value.items()})
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    return str(value)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when rows agree, otherwise what differs."""
    names = sorted(spark_df.columns)
    cursor = con.execute(sql)
    sql_names = [d[0] for d in cursor.description]
    if sorted(sql_names) != names:
        return f"columns {names} against {sorted(sql_names)}"
    order = [sql_names.index(n) for n in names]
    theirs = sorted(tuple(canonical(r[k]) for k in order) for r in cursor.fetchall())
    ours = sorted(tuple(canonical(r[n]) for n in names) for r in spark_df.select(*[f"`{n}`" for n in names]).collect())
    if ours == theirs:
        return None
    extra, missing = set(ours) - set(theirs), set(theirs) - set(ours)
    return (
        f"{len(ours)} rows against {len(theirs)}; columns {names}; only Spark: {sorted(extra)[:2]}; only SQL: {sorted(missing)[:2]}"
    )


def main(sf: str, wanted: list[str]) -> int:
    from pagemill.plans import catalog
    from pagemill.session import local_session

    spark = local_session("8")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    failed = 0
    for name, build in catalog.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in catalog.ORACLES:
                found = difference(df, con, catalog.ORACLES[name])
            else:
                found = None if df.count() > 0 else "no rows"
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql" if name in catalog.ORACLES else "rows"
        print(f"{'ok  ' if found is None else 'FAIL'} {name} ({kind}) {time.time() - start:.1f}s {found or ''}"[:2500], flush=True)
        failed += found is not None
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
