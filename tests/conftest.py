import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from parcorp.session import local_session, shared_dir  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a column rewrite on a list of strings, in one job."""
    from pyspark.sql import functions as F

    def run(rewrite, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
        out = df.select("i", rewrite(F.col("t")).alias("t")).collect()
        return [r.t for r in sorted(out)]

    return run
