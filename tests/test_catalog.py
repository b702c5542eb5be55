"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    number = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    clean = lambda v: None if pd.isna(v) else number(v)
    return sorted((tuple(clean(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
