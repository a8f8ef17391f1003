import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from check_oracle import session

    s = session()
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture
def col(spark):
    """Evaluate one expression over one row of literals."""

    def run(fn, **values):
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {_type(v)}" for k, v in values.items()))
        return df.select(fn.alias("v")).first()[0]

    def _type(v):
        if isinstance(v, list):
            return "array<string>"
        return {str: "string", float: "double", int: "bigint", type(None): "string"}[type(v)]

    return run
