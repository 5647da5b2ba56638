import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    session = local_session(cpus=8, shuffle_partitions=8, memory="6g")
    yield session
    session.stop()
