"""Every registered query of the review engine against its DuckDB twin."""

import duckdb
import pandas as pd
import pytest

from vellum.plans.logical import BASE
from vellum.plans.queries import ORACLE, QUERIES


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    clean = lambda x: None if pd.isna(x) else (round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x)
    return sorted((tuple(clean(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
