import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from textwarden.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "8"), memory="8g", app="textwarden-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
