"""Compare a registered query with its SQL in DuckDB: same columns, same rows."""

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, folder, query, sql):
    """Differences as text, empty if there are none."""
    df = query(spark, folder)
    got_columns, got = normalized(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = normalized([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"row {g} != {w}"[:1500]
    types = [{type(v) for v in column if v is not None} for column in zip(*got)]
    wanted = [{type(v) for v in column if v is not None} for column in zip(*want)]
    return "" if types == wanted else f"types {types} != {wanted}"
