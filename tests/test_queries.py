"""Queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from kinfabric.plans.catalog import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
#: Nobody is flagged in the smallest tables.
EMPTY = {"trust_spam_flags", "trust_flags_after_reset"}
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def tidy(frame):
    rows = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        rows.append(tuple("~" if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in row))
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, D).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert tidy(ours) == tidy(theirs)
    assert len(theirs) > 0 or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, D).count() > 0
