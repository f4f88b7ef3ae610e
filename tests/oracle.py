"""Runs registered queries on Spark and their SQL on DuckDB and compares whole results.

``python tests/oracle.py [name ...]`` checks the named queries, or all of them.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if value != value else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    frame = query(spark, sf_dir)
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - started
    kinds = dict(frame.dtypes)
    if sql is None:
        return True, f"rows={len(got)} {took:.1f}s (rows only)"
    started = time.time()
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    want_columns, want = rows_of(list(types), result.fetchall())
    note = f"rows={len(got)} {took:.1f}s sql {time.time() - started:.1f}s"
    if got_columns != want_columns:
        return False, f"{note} columns {got_columns} != {want_columns}"
    same_types = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = [(c, kinds[c], types[c]) for c in got_columns if same_types.get(kinds[c]) != types[c]]
    if bad:
        return False, f"{note} types {bad}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return False, f"{note} expected {len(want)} rows; {len(diff)} differ, first {got_columns} {diff[:2]}"
    return True, note if got else f"{note} EMPTY"


def main(names: list[str]) -> int:
    import __spark_entry__ as entry

    from meterflow.session import local_session

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        try:
            ok, note = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
