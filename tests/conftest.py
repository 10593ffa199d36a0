import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gridspark.session import build_session

    s = build_session("local[8]", 8, "gridspark-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from tools.check_oracles import connect

    return connect(SF)


@pytest.fixture(scope="session")
def sf():
    return SF
