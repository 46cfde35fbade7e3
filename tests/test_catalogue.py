"""Every registered reference query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tapeglass.plans import catalogue

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v != v:
            return None
        if isinstance(v, float):
            return f"{v + 0.0:.6f}"
        return str(v)[:10] if hasattr(v, "year") else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalogue.compared()[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["text_scorer", "llm_extract", "gbt_scores", "gain_importance"])
def test_rows_only(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
