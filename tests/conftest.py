import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sourceloom.session import local_session

    session = local_session(4, app="tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALLEST):
        pytest.skip("no test data")
    return SMALLEST
