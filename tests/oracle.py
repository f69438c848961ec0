"""Compares a query with its SQL on DuckDB, values by values, in any order of rows."""

from __future__ import annotations

import datetime
import math
import os
from pathlib import Path

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    """A value that sorts and compares alike from both engines."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.9g}") + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in v.items()) + "}"
    return str(v)


def rows_of_duckdb(sql: str, sf_dir: str = SF_DIR) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def in_order(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    by = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in by], sorted(tuple(plain(r[i]) for i in by) for r in rows)


def compare(spark, query, sql: str, sf_dir: str = SF_DIR) -> int:
    """The number of rows, alike on both sides; fails otherwise."""
    df = query(spark, sf_dir)
    names, mine = in_order(df.columns, [tuple(r) for r in df.collect()])
    other_names, theirs = in_order(*rows_of_duckdb(sql, sf_dir))
    assert names == other_names
    left, right = sorted(set(mine) - set(theirs)), sorted(set(theirs) - set(mine))
    assert mine == theirs, f"{len(mine)} rows against {len(theirs)}; only in Spark {len(left)}: {str(left[:3])[:600]}; only in DuckDB {len(right)}: {str(right[:3])[:600]}"
    return len(mine)
