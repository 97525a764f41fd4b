"""Every query against its SQL counterpart on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lorewright.plans import catalogue


def plain(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return (t if t.tzinfo is None else t.tz_convert("UTC").tz_localize(None)).isoformat()
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for n in os.listdir(small):
        c.sql(f"create view {n[:-8]} as select * from '{small}/{n}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, small, name):
    got = catalogue.queries()[name](spark, small).toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
