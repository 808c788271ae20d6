"""Compares a query with its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def _norm(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_norm(x) for x in value)
    return value


def check(spark, query, sql):
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, str(DATA))
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    mine = Counter(tuple(_norm(x) for x in r) for r in df.select(*names).collect())
    assert mine == Counter(tuple(_norm(x) for x in r) for r in got.fetchall())
