"""Every operator query with SQL against it on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from chronoloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want, got = duck.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got) == sorted(want) and len(got) == len(want)
    cell = lambda x: "" if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x) else repr(float(x)) if isinstance(x, (int, float)) else str(x)
    plain = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(want)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)
