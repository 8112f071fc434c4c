"""Run a query on Spark and its SQL on DuckDB and compare schema names, row count and values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark_df, con, sql):
    """(matches, message)"""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    want_names, want = rows_of(names, result.fetchall())
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        extra, lacking = set(got) - set(want), set(want) - set(got)
        return False, f"rows {len(got)} != {len(want)}; only Spark {list(extra)[:2]}, only SQL {list(lacking)[:2]}"
    for g, w in zip(got, want, strict=True):
        if repr(g) != repr(w):
            return False, f"{got_names}: {g} != {w}"
    types = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    odd = {c: (t, kinds[c]) for c, t in spark_df.dtypes if types.get(t) and types[t] not in (kinds[c], {"NUMBER": types[t], "STRING": "VARCHAR"}.get(kinds[c], ""))}
    return not odd, f"{len(got)} rows" + (f" types {odd}" if odd else "")
