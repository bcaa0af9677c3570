"""Run registered queries next to their SQL: `python -m checks.compare <folder> [name part ...]`."""

from __future__ import annotations

import sys
import time

import duckdb

from checks.queries import ORACLE, QUERIES
from tallymill.session import local_session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

SPARK_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((value is None, str(type(value)), str(value)) for value in row)


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """What differs between the two results, or None. Values have to be equal, types included."""
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(names).collect()), key=_key)
    if name not in ORACLE:
        return None
    result = con.execute(ORACLE[name])
    order = [d[0] for d in result.description]
    if sorted(order) != names:
        return f"columns {names} against {sorted(order)}"
    kinds = {d[0]: SPARK_TYPE.get(str(d[1]).upper(), str(d[1])) for d in result.description}
    if kinds != dict(df.dtypes):
        return f"types {dict(df.dtypes)} against {kinds}"
    places = [order.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in places) for r in result.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for mine, other in zip(ours, theirs):
        if mine != other or [type(v) for v in mine] != [type(v) for v in other]:
            return f"{dict(zip(names, mine))} against {dict(zip(names, other))}"
    return None


def main() -> None:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con, failed = local_session(8), connect(sf_dir), 0
    for name in QUERIES:
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, name)
        except Exception as problem:  # noqa: BLE001 - reported, next query
            found = f"{type(problem).__name__}: {str(problem)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
