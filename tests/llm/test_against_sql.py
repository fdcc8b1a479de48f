"""The queries that SQL can express against it, on the smallest tables."""

import os

import duckdb
import pytest

from tessella.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, wanted = QUERIES[name](spark, SF).toPandas(), c.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    filled = lambda d: d[columns].astype(object).where(d[columns].notna(), None)
    rows = lambda d: sorted(filled(d).map(lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v).itertuples(index=False, name=None), key=str)
    assert rows(got) == rows(wanted)
