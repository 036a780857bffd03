import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from strikeline.llm.common import ship

    ship(spark)
