"""The registered queries give the rows of their SQL on the given tables."""

import glob
import os

import duckdb
import pytest

from parcorp.llm.queries import ORACLES, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(r) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want and want
