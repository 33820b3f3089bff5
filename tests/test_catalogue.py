"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import duckdb
import pandas as pd
import pytest

from kestrel.plans import catalogue, derived, evaluated, planted  # noqa: F401  (all register their queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    value = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) else x
    return sorted((tuple(value(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalogue.queries())
def test_same_as_sql(spark, db, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = db.execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_without_llm_parts():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
