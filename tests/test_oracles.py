"""Every query with an oracle, against DuckDB over the same tables."""

import datetime
import math
import os

import duckdb
import pytest

from ledgerloom import queries as base

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    con.execute(base.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    want = rows(columns, con.fetchall())
    df = base.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, df.collect())
    assert got == want
    assert got or SF.endswith("sf0.001"), "an empty result shows nothing"


def test_every_oracle_has_a_query():
    assert set(base.oracle_sql()) <= set(base.queries())
