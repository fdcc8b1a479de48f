"""Each registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessella.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda d: sorted(map(str, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    number = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    assert rows(a.map(number)) == rows(b.map(number))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df())


def test_the_rest_has_a_plain_version():
    from tests import test_plain_versions as plain

    assert {n for n in set(QUERIES) - set(ORACLES)} <= {f.removeprefix("test_") for f in dir(plain)} | {"canonical_issues"}
