"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidelane.plans import catalog, connections, messages, packets, tracking  # noqa: F401 - each registers its queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def rows(frame):
    def plain(v):
        return None if pd.isna(v) else round(float(v), 4) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    if name in catalog.ORACLES:
        want = db.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0


def test_entry_imports():
    import __spark_entry__

    assert catalog.FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
