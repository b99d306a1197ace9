"""Every registered query with SQL against DuckDB."""

import duckdb
import pandas as pd
import pytest

from tessera.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame):
    cells = lambda v: None if pd.isna(v) else int(v) if hasattr(v, "__int__") and not isinstance(v, str) and float(v) == int(v) else v
    return sorted(str(tuple(cells(v) for v in r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
