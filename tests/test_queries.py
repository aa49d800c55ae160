"""Each query with a DuckDB text against it, at the smallest scale; nothing but the toolkit."""

import os
import tempfile

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def norm(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return f"{float(v):.3f}"
        except (TypeError, ValueError):
            return str(v)
    return sorted(tuple(norm(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_duckdb(spark, duck, name):
    got, want = rows(catalog.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(catalog.SQL[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or abs(float(x) - float(y)) <= 2e-3


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_models_return_rows(spark, name):
    df = catalog.QUERIES[name](spark, SF).cache()
    kinds = dict(df.dtypes)
    assert df.count() > 0
    for c in ("precision", "recall", "f1"):
        assert c not in kinds or not df.where(f"{c} < 0 OR {c} > 1").count()
    for c in ("RMSE", "importance", "n_test", "n_spike", "n", "gpp", "reco"):
        assert c not in kinds or not df.where(f"`{c}` < 0").count()
    df.unpersist()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
