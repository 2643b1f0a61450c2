import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from dealwright.session import local_session

    session = local_session(8, "dealwright-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over single values: one(column_function, values) -> results in order."""

    def run(make_column, values, type_="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
        return [r[0] for r in df.orderBy("i").select(make_column(F.col("v"))).collect()]

    return run
