"""Every query runs, and gives what its SQL gives in another engine."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from spindrift.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(df):
    def text(x):
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return "null"
        return repr(round(float(x), 9)) if isinstance(x, float) else str(x)

    return sorted("|".join(text(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, other, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in catalog.ORACLES:
        found = other.sql(catalog.ORACLES[name])
        want = pd.DataFrame(found.fetchall(), columns=found.columns)
        got = pd.DataFrame([tuple(r) for r in rows], columns=df.columns)
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
