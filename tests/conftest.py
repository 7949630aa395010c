import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lattica.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("lattica-tests", cores=4, shuffle_partitions=4, driver_memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a Column expression on a single row."""

    def evaluate(column, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
        return row.select(column.alias("r")).first().r

    return evaluate
