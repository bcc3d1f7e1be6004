"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, normalised

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, db, name):
    got = queries()[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    if name in oracle_sql():
        want = db.execute(oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        pd.testing.assert_frame_equal(normalised(got), normalised(want), check_dtype=False)


def test_entry(spark):
    assert entry(spark).columns[:2] == ["source_news_id", "rank"]
