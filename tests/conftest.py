import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from gleanery.session import clear_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, **{"spark__driver__memory": "4g", "spark__sql__shuffle__partitions": "4"})
    yield session
    clear_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path
