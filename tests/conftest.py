import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loomstone.session import session

    s = session("tests", "local[4]", shuffle=4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
