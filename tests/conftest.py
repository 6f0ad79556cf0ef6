import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("SCREENLENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from screenlens.sources.tables import local_session
    s = local_session("*", shuffle_partitions=8, app="screenlens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
