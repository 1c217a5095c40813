import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadloom.session import local_session, ship

DATA = os.environ.get("THREADLOOM_TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    return ship(local_session(4, 4, memory="4g"))


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"
