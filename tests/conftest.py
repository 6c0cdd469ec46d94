import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from martlet.session import build_session, remove_scratch
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="martlet-tests")
    yield s
    remove_scratch(s)
    s.stop()
