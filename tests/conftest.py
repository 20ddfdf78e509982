import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from worktrail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=8, memory="4g", app="tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
