import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from hazeframe.session import get_spark
    s = get_spark("local[4]", app="hazeframe-tests", shuffle_partitions=4)
    yield s
    s.stop()
