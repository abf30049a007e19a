import __spark_entry__ as entry
import duckdb
import glob
import os

import pytest

from tests.conftest import SF

SAMPLE = ["q_collate", "q_dedup_chain", "q_split", "q_clean_xon", "q_resolve", "q_chunk", "q_bleu", "q_photo_join", "q_running_usage"]


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    own = {name for name in queries if name.startswith("q_")}
    assert own <= set(oracles) <= set(queries) and len(own) >= 75


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "period", "genre", "transliteration", "glyph_names", "glyphs"]
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(r) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want and want
