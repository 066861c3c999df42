import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gazette.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "gazette-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def value(spark):
    """Value of a column expression over one row of named inputs."""
    from pyspark.sql import functions as F

    def run(expr, **inputs):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()])
        return row.select(expr.alias("out")).collect()[0][0]

    return run
