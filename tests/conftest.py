import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lexispan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over one row of named values."""

    def run(values: dict, **columns):
        names = list(values)
        df = spark.range(1)
        from pyspark.sql import functions as F

        def lit(v):
            if isinstance(v, list):
                return F.array(*[F.lit(x) for x in v]).cast("array<string>")
            return F.lit(v)

        df = df.select(*[lit(values[n]).alias(n) for n in names])
        row = df.select(*[c.alias(k) for k, c in columns.items()]).first()
        return row.asDict(recursive=True)

    return run
