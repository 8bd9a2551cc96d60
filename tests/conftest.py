import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from kvlens.session import local_session
    s = local_session(cores="*", shuffle_partitions=8)
    yield s


def one(spark, col_fn, values, schema="s string"):
    """Evaluate a Column function over a list of inputs, return the outputs."""
    from pyspark.sql import functions as F
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    df = spark.createDataFrame(rows, schema)
    cols = [F.col(c) for c in df.columns]
    return [r[0] for r in df.select(col_fn(*cols).alias("out")).collect()]
