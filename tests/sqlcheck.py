"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import math
import os


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return repr(float(value)) if isinstance(value, float) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def agree(spark, sf, query, sql) -> bool:
    """Same columns, same rows."""
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(sf):
        con.sql(f"create view {file.split('.')[0]} as select * from '{sf}/{file}'")
    df, want = query(spark, sf), con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want.columns, want.fetchall())
    return True
