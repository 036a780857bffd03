import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from strikeline.session import get_session

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = get_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__checkpoint__dir=folder)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    from oracle import connect

    return connect(sf_dir)
