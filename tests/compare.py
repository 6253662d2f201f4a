"""Runs queries in Spark and their SQL in DuckDB and compares the rows."""
from __future__ import annotations

import decimal
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
         "decimal(3,1)": "DECIMAL(3,1)"}


def compare(spark, con, name, query, sql, folder):
    start = time.time()
    frame = query(spark, folder)
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spark_time = time.time() - start
    if sql is None:
        return got, None, spark_time, 0.0, None
    start = time.time()
    result = con.sql(sql)
    want_columns, want = rows_of(result.columns, result.fetchall())
    problem = None
    if got_columns != want_columns:
        problem = f"columns {got_columns} / {want_columns}"
    types = {c: str(t) for c, t in zip(result.columns, result.types)}
    other = {f.name: (f.dataType.simpleString(), types.get(f.name)) for f in frame.schema
             if TYPES.get(f.dataType.simpleString()) != types.get(f.name)}
    if problem is None and other:
        problem = f"types {other}"
    if problem is None and got != want:
        extra = sorted(set(got) - set(want), key=repr)[:3]
        lacking = sorted(set(want) - set(got), key=repr)[:3]
        problem = f"rows {len(got)} / {len(want)}; only Spark {extra}; only SQL {lacking}"
    return got, want, spark_time, time.time() - start, problem


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from scanloom.session import local_session

    folder = sys.argv[1]
    chosen = sys.argv[2:]
    session, con = local_session(8), connect(folder)
    sqls = oracle_sql()
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        try:
            got, want, a, b, problem = compare(session, con, name, query, sqls.get(name), folder)
            kind = "rows only" if want is None else "DIFFERS" if problem else "same"
            print(f"{name:40} {kind:10} {len(got):8} rows  spark {a:6.2f}s  sql {b:6.2f}s  {(problem or '')[:900]}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{name:40} FAILED     {type(error).__name__}: {str(error)[:600]}", flush=True)
