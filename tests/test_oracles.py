"""Every query with SQL beside it, over the smallest tables, against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans.queries import ORACLES, QUERIES

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return c


def rows(pdf: pd.DataFrame) -> list[tuple]:
    said = lambda v: "null" if v is None or v is pd.NA or isinstance(v, float) and v != v else f"{v:.9g}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(map(said, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(5).count() > 0
