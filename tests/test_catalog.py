"""Every registered query against its SQL on whole tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import entry  # noqa: E402
from scripts.check_queries import rows_of  # noqa: E402
from tablewright.catalog.oracles import ORACLES  # noqa: E402
from tablewright.catalog.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF_DIR}/{file}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, sql, name):
    got = QUERIES[name](spark, SF_DIR)
    cursor = sql.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
