"""Runs a registered query and its SQL over the same Parquet tables and compares the rows."""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9) + 0.0
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df) -> tuple[list[str], Counter]:
    return rows_of(df.columns, df.collect())


def duck_rows(sql: str, sf_dir: str = DATA) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET threads=4")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    result = con.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def difference(spark, query, sql: str, sf_dir: str = DATA) -> str:
    """Empty if rows and columns agree."""
    names, ours = spark_rows(query(spark, sf_dir))
    other_names, theirs = duck_rows(sql, sf_dir)
    if names != other_names:
        return f"columns {names} against {other_names}"
    if ours == theirs:
        return ""
    return f"{ours.total()} rows against {theirs.total()}; only here {list((ours - theirs))[:3]}; only in SQL {list((theirs - ours))[:3]}"
