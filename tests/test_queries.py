"""Each query of the memory engine against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest
from recollect.plans import read_queries, work_queries  # noqa: F401
from recollect.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    found = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, found.fetchall())
    assert got == want, f"{sum(got.values())} rows, {sum(want.values())} wanted; only here {list((got - want).items())[:2]}, only there {list((want - got).items())[:2]}"
