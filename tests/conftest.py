import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from bodega.session import get_session
    s = get_session("local[4]", 4, app_name="bodega-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from bodega.sources.fixtures import Fixture
    return Fixture(spark, SMALL)
