"""Compare a Spark result with its SQL on DuckDB: same columns, same rows, order ignored, doubles to 6 places."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def text(v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(text(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    names = sorted(have)
    at = [have.index(n) for n in names]
    return names, sorted(tuple(text(r[i]) for i in at) for r in cur.fetchall())
