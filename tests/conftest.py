import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tablewright.session import local_session

    session = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows in the order given, in one partition."""

    def build(rows, columns, types=None):
        schema = ", ".join(f"`{c}` {t}" for c, t in zip(columns, types or ["string"] * len(columns)))
        return spark.createDataFrame(rows, schema).coalesce(1)

    return build
