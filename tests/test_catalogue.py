"""Each query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from passagix.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([tuple(r) for r in df.select(*columns).collect()]), key=str)
    want = sorted(duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=str)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
