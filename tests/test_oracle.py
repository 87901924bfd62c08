"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from meterline import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v != v:
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def table(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.ORACLE_SQL:
        assert len(set(got.columns)) == len(got.columns) > 0
        return
    cursor = db.execute(plans.ORACLE_SQL[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[c[0] for c in cursor.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)
