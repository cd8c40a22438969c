"""Compare a query's rows with those of its SQL, column by column."""

import math

import duckdb

from tablepact.suite.registry import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def difference(df, con, sql):
    """None if the rows agree, otherwise what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} != {names}"
    want, got = rows_of(names, result.fetchall()), rows_of(df.columns, df.collect())
    if want == got:
        return None
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows, expected {len(want)}; only here {only_got}; only there {only_want}"
